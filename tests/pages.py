"""A small catalog of pages for the matching tests; texts are labels."""


def option(text, short=(), long=(), has_arg=False, positional=None, prefix=None, nested=False):
    return {"text": text, "short": list(short), "long": list(long), "has_arg": has_arg, "positional": positional, "prefix": prefix, "nested": nested}


BASE = [option("A", ["-a"], ["--a"]), option("B", ["-b"], ["--b"], True), option("Q", ["-?"]), option("C", ["-c"], has_arg=["one", "two"])]
EXT = [*BASE, option("F", positional="FILE"), option("X", ["-exec"], has_arg=True, nested=["EOF", ";"])]


def page(name, options=(), synopsis=None, section="1", **more):
    return {"source": f"ubuntu/26.04/{section}/{name}.{section}.gz", "name": name, "section": section, "synopsis": synopsis if synopsis is not None else f"{name} synopsis", "options": list(options), "dashless": False, "subcommands": [], "nested": False, "suggestions": []} | more


PAGES = {
    "bar": page("bar", BASE, subcommands=["foo"]),
    "baz": page("baz", BASE, dashless=True),
    "bar foo": page("bar-foo", BASE),
    "nosynopsis": page("nosynopsis", BASE, synopsis=""),
    "dup": page("dup", BASE, suggestions=[{"source": "ubuntu/26.04/2/dup.2.gz"}]),
    "withargs": page("withargs", EXT, dashless=True, nested=True),
    "withmultipos": page("withmultipos", [*BASE, option("SOURCE", positional="SOURCE"), option("DEST", positional="DEST")]),
    "withprefixpos": page("withprefixpos", [option("server", positional="server", prefix="@"), option("name", positional="name"), option("type", positional="type")]),
    "onlyprefixpos": page("onlyprefixpos", [option("display", positional="display", prefix=":")]),
}

#: (line, spans of each command, spans of the shell, expansions): S is a synopsis, ? unknown.
GOLDEN = [
    ("bar -b uniקוד", ["0,3=S 4,13=B"], "", ""),
    ("bar -a --a -?", ["0,3=S 4,10=A 11,13=Q"], "", ""),
    ("baz -ab arg", ["0,3=S 4,6=A 6,11=B"], "", ""),
    ("baz -ab12", ["0,3=S 4,6=A 6,9=B"], "", ""),
    ("withargs arg", ["0,8=S 9,12=F"], "", ""),
    ("withmultipos src.txt dst.txt", ["0,12=S 13,20=SOURCE 21,28=DEST"], "", ""),
    ("withmultipos a b c", ["0,12=S 13,14=SOURCE 15,18=DEST"], "", ""),
    ("withmultipos DEST", ["0,12=S 13,17=DEST"], "", ""),
    ("withprefixpos ns foo.bar @8.8.8.8", ["0,13=S 14,16=name 17,24=type 25,33=server"], "", ""),
    ("withprefixpos @a @b", ["0,13=S 14,19=server"], "", ""),
    ("withmultipos @x", ["0,12=S 13,15=SOURCE"], "", ""),
    ("withprefixpos server", ["0,13=S 14,20=name"], "", ""),
    ("onlyprefixpos :1", ["0,13=S 14,16=display"], "", ""),
    ("onlyprefixpos foo", ["0,13=S 14,17=?"], "", ""),
    ("withargs -ab12 arg", ["0,8=S 9,11=A 11,14=B 15,18=F"], "", ""),
    ("withargs -b12 arg", ["0,8=S 9,13=B 14,17=F"], "", ""),
    ("withargs -b 12 arg", ["0,8=S 9,14=B 15,18=F"], "", ""),
    ("bar -b arg --b arg", ["0,3=S 4,18=B"], "", ""),
    ("bar -c one", ["0,3=S 4,10=C"], "", ""),
    ("bar -c notinlist", ["0,3=S 4,6=C 7,16=?"], "", ""),
    ("bar -b -a", ["0,3=S 4,6=B 7,9=A"], "", ""),
    ("bar -b -xa", ["0,3=S 4,6=B 7,9=? 9,10=A"], "", ""),
    ("bar -b '-foo'", ["0,3=S 4,13=B"], "", ""),
    ("bar -b '-7 days'", ["0,3=S 4,16=B"], "", ""),
    ("bar -x", ["0,3=S 4,6=?"], "", ""),
    ("bar -x --x", ["0,3=S 4,10=?"], "", ""),
    ("bar -xyz", ["0,3=S 4,8=?"], "", ""),
    ("bar -xaz", ["0,3=S 4,6=? 6,7=A 7,8=?"], "", ""),
    ("bar -aaa", ["0,3=S 4,8=A"], "", ""),
    ("bar --b=b foo", ["0,3=S 4,9=B 10,13=?"], "", ""),
    ("baz ab -x", ["0,3=S 4,5=A 5,6=B 7,9=?"], "", ""),
    ("bar baz --b foo", ["0,3=S 4,7=? 8,15=B"], "", ""),
    ("bar foo --b foo", ["0,7=S 8,15=B"], "", ""),
    ("dup -ab", ["0,3=S 4,6=A 6,7=B"], "", ""),
    ("withargs -x -b freearg freearg", ["0,8=S 9,11=? 12,22=B 23,30=F"], "", ""),
    ("bar -b - -a -", ["0,3=S 4,8=B 9,11=A 12,13=?"], "", ""),
    ("withargs -b arg bar -a unknown", ["0,8=S 9,15=B", "16,19=S 20,22=A 23,30=?"], "", ""),
    ("withargs -b arg -exec bar -a EOF -b arg", ["0,8=S 9,15=B 16,21=X 29,32=X 33,39=B", "22,25=S 26,28=A"], "", ""),
    ("withargs -b arg -exec bar -a ';' -a", ["0,8=S 9,15=B 16,21=X 29,32=X 33,35=A", "22,25=S 26,28=A"], "", ""),
    (r"withargs -b arg -exec bar -a \; -a", ["0,8=S 9,15=B 16,21=X 29,31=X 32,34=A", "22,25=S 26,28=A"], "", ""),
    ("withargs -exec bar -a -u", ["0,8=S 9,14=X", "15,18=S 19,21=A 22,24=?"], "", ""),
    ("withargs withargs -b arg bar", ["0,8=S", "9,17=S 18,24=B", "25,28=S"], "", ""),
    ("withargs -b arg unknown", ["0,8=S 9,15=B 16,23=F"], "", ""),
    ("bar; foo arg >f; baz", ["0,3=S", "5,12=?", "17,20=S"], "3,4=; 13,15=> 15,16=;", ""),
    ("bar | baz", ["0,3=S", "6,9=S"], "4,5=pipe", ""),
    ("((bar); bar)", ["2,5=S", "8,11=S"], "0,2=subshell 5,6=subshell 6,7=; 11,12=subshell", ""),
    ("2>&1", [], "0,4=>", ""),
    ("2>&1 bar", ["5,8=S"], "0,4=>", ""),
    ("bar $(a) -b \"b $(c) `c`\" '$(d)' >$(e) `f`", ["0,3=S 4,8=? 9,24=B 25,31=? 38,41=?"], "32,37=>", "6,7=substitution 17,18=substitution 21,22=substitution 35,36=substitution 39,40=substitution"),
    ("withargs $(a) $0", ["0,8=S 9,16=F"], "", "11,12=substitution 14,16=parameter-digits"),
    ("$(a) b", ["0,6=?"], "", "2,3=substitution"),
    ("withargs -b <(a) >(b)", ["0,8=S 9,16=B 17,21=F"], "", "14,15=substitution 19,20=substitution"),
    ("if bar -a; then b; fi", ["3,6=S 7,9=A", "16,17=?"], "0,2=if 9,15=if 17,21=if", ""),
    ("for a; do while bar; do baz; done; done", ["16,19=S", "24,27=S"], "0,9=for 10,15=loop 19,23=loop 27,33=loop 33,39=for", ""),
    ("for a in $(bar); do baz; done", ["20,23=S"], "0,19=for 23,29=for", "11,14=substitution"),
    ('a="$1" bar', ["7,10=S"], "0,6=assignment", "3,5=parameter-digits"),
    ("a=b bar", ["4,7=S"], "0,3=assignment", ""),
    ("a $(b $(c))", ["0,11=?"], "", "4,10=substitution"),
    ("function a() { bar; }", ["15,18=S"], "0,14=function 18,19=; 20,21=function", ""),
    ("function a() { bar; a b; }; a", ["15,18=S"], "0,14=function 18,19=; 20,21=call 22,23=arg 23,24=; 25,26=function 26,27=; 28,29=call", ""),
    ("bar # a comment", ["0,3=S"], "4,15=comment", ""),
    ("bar;#a comment", ["0,3=S"], "3,4=; 4,14=comment", ""),
    ("# just a comment", [], "0,16=comment", ""),
    ("bar <<EOF", ["0,3=S"], "4,9=<<", ""),
    ("nosynopsis a", ["0,10=S 11,12=?"], "", ""),
]
