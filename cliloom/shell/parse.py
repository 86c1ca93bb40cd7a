"""A shell command line as a flat list of events, left to right.

Events (positions are half-open, in code points):

* ``("command", items)``: a simple command; items are ``("word", Word)`` and
  ``("mark", start, end, label)`` (redirections, assignments), in order;
* ``("key", start, end, word)``: a reserved word or an operator, whose meaning
  depends on the compound command around it;
* ``("mark", start, end, label)``: a span that explains itself;
* ``("push", kind)`` and ``("pop", kind)``: a compound command begins or ends;
* ``("define", name)``: from here on the name is a function;
* ``("expansion", start, end, kind)``.

Substitutions aren't parsed: one level deep, only their place is noted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Kinds of special parameters.
PARAMETERS = {"*": "star", "@": "at", "#": "pound", "?": "question", "-": "hyphen", "$": "dollar", "!": "exclamation", "0": "zero", "_": "underscore"}
#: Redirections with an explanation of their own.
REDIRECTIONS = ("<", ">", ">>", "&>", ">&", "&>>", "<<", "<<<")
_OPERATOR = re.compile(r"&&|\|\||\|&|;;|[;&|()\n]")
_REDIRECT = re.compile(r"(\d+)?(<<<|<<-|<<|<&|<>|>>|>&|>\||<|>)|&>>|&>")
_ASSIGN = re.compile(r"[A-Za-z_]\w*(\[[^\]]*\])?\+?=")
_NAME = re.compile(r"[A-Za-z_]\w*")
_BLANK = " \t"
_META = set(" \t\n;&|()<>")
_OPENERS = {"if", "for", "while", "until", "{", "case", "select", "function", "[["}
_CLOSERS = {"then", "elif", "else", "fi", "do", "done", "}", "esac"}


class ParseError(ValueError):
    """The line isn't a command of this grammar."""


class Unsupported(NotImplementedError):
    """The line uses a construct that isn't explained."""


@dataclass
class Word:
    start: int
    end: int
    text: str
    expansions: list[tuple[int, int, str]] = field(default_factory=list)
    bare: bool = True  # nothing in it is quoted


@dataclass
class _Token:
    kind: str  # word, op, redirect, end
    start: int
    end: int
    text: str
    word: Word | None = None
    fd: str = ""


class Parser:
    def __init__(self, line: str):
        self.s, self.at, self.events = line, 0, []
        self.last = 0  # the end of the last token taken
        self.ahead: _Token | None = None

    # Words.

    def _closing(self, at: int, closer: str) -> int:
        """The place of the bracket that closes what was opened before `at`."""
        s, opener, depth = self.s, {")": "(", "}": "{"}[closer], 1
        while at < len(s):
            c = s[at]
            if c == "\\":
                at += 1
            elif c == "'":
                at = s.find("'", at + 1)
                if at < 0:
                    break
            elif c == '"':
                at = self._quoted_end(at + 1)
            elif c == opener:
                depth += 1
            elif c == closer:
                depth -= 1
                if not depth:
                    return at
            at += 1
        raise ParseError(f"{closer!r} is missing")

    def _quoted_end(self, at: int) -> int:
        s = self.s
        while at < len(s):
            if s[at] == "\\":
                at += 1
            elif s[at] == '"':
                return at
            elif s.startswith("$(", at):
                at = self._closing(at + 2, ")")
            at += 1
        raise ParseError("a quote is missing")

    def _expansion(self, at: int, found: list) -> int:
        """The end of the expansion at `at`, or `at` if there is none; notes it in found."""
        s = self.s
        if s[at] == "`":
            end = s.find("`", at + 1)
            if end < 0:
                raise ParseError("a backtick is missing")
            found.append((at + 1, end, "substitution"))
            return end + 1
        rest = s[at + 1 : at + 2]
        if rest == "(":
            end = self._closing(at + 2, ")")
            if s.startswith("((", at + 1) and s[end - 1 : end] == ")":
                return end + 1  # arithmetic: no substitution
            found.append((at + 2, end, "substitution"))
            return end + 1
        if rest == "{":
            end = self._closing(at + 2, "}")
            inner = s[at + 2 : end]
            name = _NAME.match(inner)
            value = name[0] if name else (re.match(r"\d+", inner) or [inner[:1]])[0]
            found.append((at, end + 1, "parameter-" + self._kind(value)))
            return end + 1
        if name := _NAME.match(s, at + 1):
            found.append((at, name.end(), "parameter-" + self._kind(name[0])))
            return name.end()
        if rest and (rest.isdigit() or rest in PARAMETERS):
            found.append((at, at + 2, "parameter-" + self._kind(rest)))
            return at + 2
        return at

    @staticmethod
    def _kind(value: str) -> str:
        return "digits" if value.isdigit() else PARAMETERS.get(value, "param")

    def _word(self) -> Word:
        s, start, text = self.s, self.at, []
        word, at = Word(start, start, ""), start
        if s[at] == "~":
            end = at + 1
            while end < len(s) and s[end] not in _META and s[end] != "/":
                end += 1
            word.expansions.append((at, end, "tilde"))
        while at < len(s):
            c = s[at]
            if c in "<>" and s.startswith("(", at + 1):
                end = self._closing(at + 2, ")")
                word.expansions.append((at + 2, end, "substitution"))
                text.append(s[at : end + 1])
                at = end + 1
            elif c in _META:
                break
            elif c == "\\":
                text.append(s[at + 1 : at + 2])
                word.bare = False
                at += 2
            elif c == "'":
                end = s.find("'", at + 1)
                if end < 0:
                    raise ParseError("a quote is missing")
                text.append(s[at + 1 : end])
                word.bare, at = False, end + 1
            elif c == '"':
                end, at, word.bare = self._quoted_end(at + 1), at + 1, False
                while at < end:
                    if s[at] == "\\" and s[at + 1] in '"\\$`':
                        text.append(s[at + 1])
                        at += 2
                    elif s[at] in "$`" and (to := self._expansion(at, word.expansions)) > at:
                        text.append(s[at:to])
                        at = to
                    else:
                        text.append(s[at])
                        at += 1
                at = end + 1
            elif c in "$`" and (to := self._expansion(at, word.expansions)) > at:
                text.append(s[at:to])
                at = to
            else:
                text.append(c)
                at += 1
        self.at = min(at, len(s))
        word.end, word.text = self.at, "".join(text)
        return word

    # Tokens.

    def _scan(self) -> _Token:
        s = self.s
        while self.at < len(s) and (s[self.at] in _BLANK or s.startswith("\\\n", self.at)):
            self.at += 1 if s[self.at] in _BLANK else 2
        at = self.at
        if at >= len(s) or s[at] == "#":
            return _Token("end", at, at, "")
        if m := _REDIRECT.match(s, at):
            if not (s[m.end() - 1] in "<>" and s.startswith("(", m.end()) and m[0] in "<>"):
                self.at = m.end()
                return _Token("redirect", at, m.end(), m[2] or m[0], fd=m[1] or "")
        if m := _OPERATOR.match(s, at):
            self.at = m.end()
            return _Token("op", at, m.end(), m[0])
        word = self._word()
        return _Token("word", word.start, word.end, word.text, word)

    def peek(self) -> _Token:
        if self.ahead is None:
            self.ahead = self._scan()
        return self.ahead

    def take(self) -> _Token:
        token, self.ahead = self.peek(), None
        if token.kind != "end":
            self.last = token.end
        return token

    def _is(self, *texts: str) -> bool:
        """Whether the next token is one of these operators or bare words."""
        t = self.peek()
        return t.text in texts and (t.kind == "op" or t.kind == "word" and t.word.bare)

    def _key(self) -> None:
        t = self.take()
        self.events.append(("key", t.start, t.end, t.text))

    def _want(self, text: str) -> None:
        if not self._is(text):
            raise ParseError(f"{text!r} is missing at {self.peek().start}")
        self._key()

    # Grammar.

    def parse(self) -> tuple[list[tuple], int]:
        """(events, end of what was parsed); a line of comments or blanks has none."""
        if self.peek().kind == "end":
            return [], 0
        self._list(top=True)
        t = self.peek()
        if t.kind != "end" and t.text != "\n":
            raise ParseError(f"{t.text!r} is unexpected at {t.start}")
        return self.events, self.last

    def _list(self, top: bool = False) -> None:
        while True:
            if not top:
                while self._is("\n"):
                    self.take()
            self._and_or()
            if self._is(";", "&"):
                self._key()
            elif not top and self._is("\n"):
                self.take()
            else:
                return
            t = self.peek()
            if t.kind == "end" or t.text in (")", "\n") and t.kind == "op" or t.kind == "word" and t.word.bare and t.text in _CLOSERS:
                if not (t.text == "\n" and not top):
                    return

    def _and_or(self) -> None:
        self._pipeline()
        while self._is("&&", "||"):
            self._key()
            self._pipeline()

    def _pipeline(self) -> None:
        if self._is("!"):
            self._key()
        self._command()
        while self._is("|", "|&"):
            t = self.take()
            self.events.append(("mark", t.start, t.end, "pipe"))
            self._command()

    def _redirect(self, out: list) -> None:
        t = self.take()
        target = self.peek()
        if target.kind != "word":
            raise ParseError(f"a redirection without a target at {t.start}")
        self.take()
        kind = t.text
        if kind == ">&" and target.text.isdigit():
            kind = ">"
        out.append(("mark", t.start, target.end, "redirect:" + kind if kind in REDIRECTIONS else "redirect"))
        self.events += [("expansion", *x) for x in target.word.expansions]

    def _redirects(self) -> None:
        while self.peek().kind == "redirect":
            self._redirect(self.events)

    def _command(self) -> None:
        t = self.peek()
        if t.kind == "op" and t.text == "(":
            self._key()
            self._list()
            self._want(")")
            self._redirects()
            return
        if t.kind == "word" and t.word.bare:
            if t.text in ("case", "select", "[["):
                raise Unsupported(t.text)
            if t.text in _CLOSERS:
                raise ParseError(f"{t.text!r} is unexpected at {t.start}")
            if t.text in _OPENERS:
                {"{": self._braces, "if": self._if, "for": self._for, "while": self._loop, "until": self._loop, "function": self._function}[t.text]()
                self._redirects()
                return
        self._simple()

    def _braces(self) -> None:
        self._key()
        self._list()
        self._want("}")

    def _if(self) -> None:
        self.events.append(("push", "if"))
        self._key()
        self._list()
        self._want("then")
        self._list()
        while self._is("elif"):
            self._key()
            self._list()
            self._want("then")
            self._list()
        if self._is("else"):
            self._key()
            self._list()
        self._want("fi")
        self.events.append(("pop", "if"))

    def _loop(self) -> None:
        kind = self.peek().text
        self.events.append(("push", kind))
        self._key()
        self._list()
        self._want("do")
        self._list()
        self._want("done")
        self.events.append(("pop", kind))

    def _for_word(self) -> None:
        t = self.take()
        if t.kind != "word":
            raise ParseError(f"a word is missing at {t.start}")
        self.events.append(("mark", t.start, t.end, "compound:for"))
        self.events += [("expansion", *x) for x in t.word.expansions]

    def _for(self) -> None:
        self.events.append(("push", "for"))
        self._key()
        if self._is("("):
            raise Unsupported("for ((")
        self._for_word()
        if self._is("in"):
            self._key()
            while self.peek().kind == "word":
                self._for_word()
        if self._is(";"):
            self._key()
        while self._is("\n"):
            self.take()
        if self._is("{"):
            self._braces()
        else:
            self._want("do")
            self._list()
            self._want("done")
        self.events.append(("pop", "for"))

    def _function(self, start: int | None = None) -> None:
        """From the word `function`, or from `()` behind a name."""
        if start is None:
            start = self.take().start
            name = self.take().text
            if self._is("("):
                self.take()
                self._plain(")")
        else:
            name = self._defined
            self._plain("(")
            self._plain(")")
        header = self.last
        self.events.append(("define", name))
        while self._is("\n"):
            self.take()
        if self._is("{"):
            brace = self.take()
            self.events.append(("mark", start, brace.end, "function"))
            self._list()
            if not self._is("}"):
                raise ParseError("'}' is missing")
            brace = self.take()
            self.events.append(("mark", brace.start, brace.end, "function"))
        else:
            self.events.append(("mark", start, header, "function"))
            if not (self._is("(") or self.peek().text in _OPENERS):
                raise ParseError("a function without a body")
            self._command()

    def _plain(self, text: str) -> None:
        if not self._is(text):
            raise ParseError(f"{text!r} is missing at {self.peek().start}")
        self.take()

    def _simple(self) -> None:
        items: list[tuple] = []
        at = len(self.events)
        named = False
        while True:
            t = self.peek()
            if t.kind == "redirect":
                self._redirect(items)
            elif t.kind == "word":
                self.take()
                m = _ASSIGN.match(self.s, t.start)
                if not named and m and m.end() <= t.end:
                    items.append(("mark", t.start, t.end, "assignment"))
                    self.events += [("expansion", *x) for x in t.word.expansions]
                    continue
                if not named and not items and t.word.bare and self._is("(") and self.peek().start == t.end or not named and not items and self._is("(") and self._closes_at_once():
                    self._defined = t.text
                    self._function(t.start)
                    return
                named = True
                items.append(("word", t.word))
            else:
                break
        if not items:
            t = self.peek()
            raise ParseError(f"{t.text or 'the end'!r} is unexpected at {t.start}")
        self.events.insert(at, ("command", items))

    def _closes_at_once(self) -> bool:
        return re.match(r"\s*\)", self.s[self.peek().end :]) is not None


def parse(line: str) -> tuple[list[tuple], int]:
    return Parser(line).parse()
