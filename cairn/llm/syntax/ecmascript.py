"""JavaScript, JSX and TypeScript."""

from __future__ import annotations

import re

from cairn.llm.syntax.engine import ERROR, NEWLINE, Language

#: Reserved words of ECMAScript modules.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof"
    " new null return super switch this throw true try typeof var void while with enum".split()
)
_OPERATORS = "; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #"

_GRAMMAR = """
Stmts = Stmt**
TopStmts = Top**
OneFn = 'export'?? 'default'?? (FuncDecl | Func | Member) | ('export')?? Var SEMI | ~T'declare' FuncDecl |~ Postfix '=' Assign SEMI | Prop ','??
Top = Import | Export | Stmt
Import = 'import' (STR | ImportWhat 'from' STR) ('with' C[*])?? SEMI
ImportWhat = ~T('type')?~ (ID (',' ('*' 'as' ID | C[Specs]))?? | '*' 'as' ID | C[Specs])
Specs = (Spec (',' Spec)** ','??)??
Spec = ~T('type')?~ (IDN | STR) ('as' (IDN | STR))??
Export = 'export' ('default' (Func | Class | ~T'interface' ID TypeParams?? Extends?? C[TypeBody] |~ Assign SEMI) | '*' ('as' (IDN | STR))?? 'from' STR SEMI
  | ~T('type')?~ C[Specs] ('from' STR)?? SEMI | Decl ~T| '=' Expr SEMI | 'as' 'namespace' ID SEMI~)
Decl = Var SEMI | FuncDecl | Decor** ClassDecl ~T| TsDecl~
Var = ('var' | 'let' | 'const') Bind (',' Bind)**
Bind = Pattern ~T('!')?? (':' Type)??~ ('=' Assign)??
Stmt = ';' | C[Stmts] | Decl | 'if' P[Expr] Stmt ('else' Stmt)?? | 'for' 'await'?? P[For] Stmt | 'while' P[Expr] Stmt | 'do' Stmt 'while' P[Expr] ';'??
  | 'return' (SEMI | NONL Expr SEMI) | 'break' (NONL ID)?? SEMI | 'continue' (NONL ID)?? SEMI | 'throw' NONL Expr SEMI | 'debugger' SEMI
  | 'try' C[Stmts] ('catch' P[Catch]?? C[Stmts] ('finally' C[Stmts])?? | 'finally' C[Stmts]) | 'switch' P[Expr] C[Cases] | ID ':' Stmt | NOFN Expr SEMI
  ~S| 'with' P[Expr] Stmt~
Cases = (('case' Expr | 'default') ':' Stmt**)**
For = (Var | Expr)?? ';' Expr?? ';' Expr?? | (('var' | 'let' | 'const') Pattern | Expr0) ('of' Assign | 'in' Expr) | ('var' | 'let' | 'const') Pattern ('of' Assign | 'in' Expr)
Expr0 = Postfix
Catch = Pattern ~T(':' Type)??~
Expr = Assign (',' Assign)**
Assign = Arrow | 'yield' (NONL '*'? Assign)? | Cond (AsgOp Assign)??
AsgOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
Cond = Binary ('?' Assign ':' Assign)??
Binary = (Unary | PRIV) (BinOp Unary)** ~TTail~
BinOp = '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' | ADJ ADJ?? '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '<<' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
  ~T| ('as' | 'satisfies') ('const' | Type) BinOp~
Tail = (NONL ('as' | 'satisfies') ('const' | Type))*
Unary = ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | ~T'<' Type CLOSE~)* Postfix
Postfix = Primary Suffix* (NONL ('++' | '--'))??
Suffix = '.' (IDN | PRIV) | '?.' (IDN | PRIV | P[Args] | B[Expr] | TPL) | P[Args] | B[Expr] | TPL ~T| NONL '!' | TypeArgs P[Args] | TypeArgs TPL~
PRIV = '#' IDN
Primary = ID | NUM | STR | TPL | RE | JSX | 'this' | 'super' | 'null' | 'true' | 'false' | P[Expr] | B[Elems] | C[Object] | Func | Decor** Class
  | 'new' New | 'import' (P[Args] | '.' IDN)
New = 'new' New | '.' ID | (ID | 'this' | 'super' | P[Expr] | Func | Class | B[Elems] | C[Object] | 'import' '.' IDN) ('.' (IDN | PRIV) | B[Expr])* ~TTypeArgs?~ P[Args]??
Elems = ','** ((('...')?? Assign) (','+ ('...')?? Assign)** ','**)??
Args = ((('...')?? Assign) (',' ('...')?? Assign)** ','??)??
Object = (Prop (',' Prop)** ','??)??
Prop = '...' Assign | ('get' | 'set') PropName P[Params] ~T(':' Ret)??~ C[Stmts] | 'async'? '*'? PropName ~TTypeParams??~ P[Params] ~T(':' Ret)??~ C[Stmts]
  | PropName ':' Assign | ID ('=' Assign)??
PropName = IDN | STR | NUM | B[Expr]
Arrow = 'async'? (ID | ~TTypeParams??~ P[Params] ~T(':' Ret)?~) NONL '=>' (C[Stmts] | Assign)
FuncDecl = ('async' NONL)?? 'function' '*'?? ID ~TTypeParams??~ P[Params] ~T(':' Ret)??~ (C[Stmts] ~T| SEMI~)
ClassDecl = ~T('abstract')??~ 'class' ID ~TTypeParams??~ ('extends' Postfix ~TTypeArgs??~)?? ~T('implements' Type (',' Type)**)??~ C[Members]
Func = 'async'? 'function' '*'?? ID?? ~TTypeParams??~ P[Params] ~T(':' Ret)??~ (C[Stmts] ~T| SEMI~)
Class = ~T('abstract')??~ 'class' ID?? ~TTypeParams??~ ('extends' Postfix ~TTypeArgs??~)?? ~T('implements' Type (',' Type)**)??~ C[Members]
Members = (';' | Member)**
Member = Decor** Mods ('static'? C[Stmts] | ('get' | 'set')? MemberName P[Params] ~T(':' Ret)??~ MethodBody
  | 'async'? '*'? MemberName ~T('?')?? TypeParams??~ P[Params] ~T(':' Ret)??~ MethodBody | 'accessor'? MemberName ~T('?' | '!')?? (':' Type)??~ ('=' Assign)?? SEMI
  ~T| B[IndexSig] ':' Type SEMI~)
MethodBody = C[Stmts] ~T| SEMI~
Mods = ('static' ~T| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'~)*
MemberName = PropName | PRIV
Decor = '@' (P[Expr] | ID ('.' IDN)** ~TTypeArgs??~ P[Args]??)
Params = (Param (',' Param)** ','??)??
Param = Decor** ~T('public' | 'private' | 'protected' | 'readonly' | 'override')*~ ('...')?? (Pattern ~T| 'this'~) ~T('?')?? (':' Type)??~ ('=' Assign)??
Pattern = ID | B[PatElems] | C[PatProps]
PatElems = ','** (PatElem (','+ PatElem)** ','**)??
PatElem = ('...')?? Pattern ('=' Assign)??
PatProps = (PatProp (',' PatProp)** ','??)??
PatProp = '...' ID | PropName ':' Pattern ('=' Assign)?? | ID ('=' Assign)??
"""

_TYPES = """
TsDecl = 'interface' ID TypeParams?? Extends?? C[TypeBody] | 'type' ID TypeParams?? '=' Type SEMI | 'const'? 'enum' ID C[EnumBody]
  | 'declare' (TsDecl | Var SEMI | Func | Class | 'global' C[Stmts]) | ('namespace' | 'module') (STR | ID ('.' ID)**) (C[TopStmts] | SEMI) | 'import' ID '=' Expr SEMI
Extends = 'extends' Type (',' Type)**
EnumBody = (EnumItem (',' EnumItem)** ','??)??
EnumItem = PropName ('=' Assign)??
TypeParams = '<' TypeParam (',' TypeParam)** ','?? CLOSE
CLOSE = '>' | ADJ
TypeParam = ('const' | 'in' | 'out')* ID ('extends' Type)?? ('=' Type)??
TypeArgs = '<' Type (',' Type)** CLOSE
Ret = Type | 'asserts' (ID | 'this') ('is' Type)?? | (ID | 'this') 'is' Type
Type = FnType | ('|' | '&')?? TypeOp (('|' | '&') TypeOp)** ('extends' Type '?' Type ':' Type)??
FnType = 'abstract'?? 'new'?? TypeParams?? P[Params] '=>' Ret
TypeOp = ('keyof' | 'readonly' | 'unique' | 'infer')* TypeAtom (NONL (B[TypeIndex]))**
TypeAtom = (ID | 'void' | 'null' | 'this' | 'true' | 'false') ('.' IDN)** (NONL TypeArgs)? | STR | '-'?? NUM | TPL | 'typeof' (ID | 'this' | 'import' P[Args]) ('.' (IDN | PRIV))** TypeArgs?
  | 'import' P[Args] ('.' IDN)** TypeArgs? | P[TypeParen] | B[Tuple] | C[TypeBody] | C[Mapped]
TypeParen = Type
TypeIndex = Type??
Tuple = (TupleItem (',' TupleItem)** ','??)??
TupleItem = ('...')?? (ID '?'?? ':' Type | Type '?'??)
TypeBody = (TypeMember (',' | SEMI))** TypeMember??
TypeMember = ('readonly' | '-' | '+')* ('get' | 'set')? (PropName '?'?? (':' Type)?? | PropName '?'?? TypeParams?? P[Params] (':' Ret)?? | 'new'?? TypeParams?? P[Params] (':' Ret)?? | B[IndexSig] ':' Type)
IndexSig = ID ':' Type
Mapped = ('readonly' | '+' 'readonly' | '-' 'readonly')?? B[MapKey] (('+' | '-')?? '?')?? (':' Type)?? SEMI
MapKey = ID 'in' Type ('as' Type)??
"""

#: Bracketed content that each kind of bracket is tried as.
_FRAGMENTS = {
    "P": ("Expr", "Args", "Params", "For", "Catch"),
    "B": ("Expr", "Elems", "PatElems"),
    "C": ("Stmts", "Object", "Members", "PatProps", "Cases", "Specs"),
}
_TS_FRAGMENTS = {
    "P": (*_FRAGMENTS["P"], "TypeParen"),
    "B": (*_FRAGMENTS["B"], "TypeIndex", "Tuple", "IndexSig", "MapKey"),
    "C": (*_FRAGMENTS["C"], "TypeBody", "EnumBody", "Mapped", "TopStmts"),
}

#: Marks that stand for a template and for a JSX element once their insides are checked.
_TPL_MARK, _JSX_MARK = "", ""
REGEX_LITERAL = (
    r"(?:(?<=[(,=:\[!&|?{};>+\-*%~^<\n])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|\A)"
    r"[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*"
)
_ESCAPE = r"\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\}"
_TOKEN = re.compile(
    REGEX_LITERAL + r"|[ \t\f\v   -   　﻿]+|\r\n?|[\n  ]"
    rf"|(?:[^\W\d]|\$|{_ESCAPE})(?:[\w$̀-ͯ‌‍]|{_ESCAPE})*"
    r"|//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/"
    r"|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
    r"|(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?:[^\W\d]\w*)?"
    r"|===|!==|\*\*=|<<=|>>=|>>>=|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|>{2,}"
    r"|[\s\S]"
)
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?:0|[1-9]\d*(?:_\d+)*))n?|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?")
_TEMPLATE = re.compile(r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`")
_SKIP = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`|[{}]|" + REGEX_LITERAL
    + r"|(?:(?<=[(=?:&|,>\[{;!])|(?<=\breturn)|(?<=\bdefault)|^)\s*<(?=[A-Za-z_>])",
    re.M,
)
_TEXT = re.compile(r"[^<{]+")
_SLASH_AFTER = re.compile(r"[)}][ \t]*/(?![/*])")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_SPACE = re.compile(r"\s*(?:/\*[\s\S]*?\*/\s*)*")


def _apart(m: re.Match) -> str:
    """A line end before a slash that begins a regular expression: after a block, or after the condition of a statement."""
    if m.group()[0] == ")":
        depth, i = 0, m.start()
        while i >= 0:
            depth += (m.string[i] == ")") - (m.string[i] == "(")
            if not depth:
                break
            i -= 1
        if not re.search(r"\b(?:if|while|for|with)\s*$", m.string[max(0, i - 40) : max(0, i)]):
            return m.group()
    return m.group()[:-1] + "\n/"


def _grammar(ts: bool, script: bool) -> str:
    text = _GRAMMAR + (_TYPES if ts else "")
    text = re.sub(r"~T((?:(?!~T)[^~]|'~')*?)~", r"\1" if ts else "", text)
    return re.sub(r"~S((?:[^~]|'~')*?)~", r"\1" if script else "", text)


class EcmaScript:
    """``check(text)`` tells whether a text is valid. ``jsx``: JSX elements are read; ``ts``: TypeScript; ``script``: no module."""

    def __init__(self, jsx: bool = False, ts: bool = False, script: bool = False) -> None:
        self.jsx, self.ts, self.script = jsx, ts, script
        self.language = Language(
            _grammar(ts, script), RESERVED if script else RESERVED | {"await", "yield"}, _TS_FRAGMENTS if ts else _FRAGMENTS, _OPERATORS,
            {"NUM": "n", "STR": "s", "TPL": "t", "RE": "r", "JSX": "x", "ADJ": "g"}, {"Stmts": "Stmts", "TopStmts": "TopStmts", "Members": "Members", "Cases": "Cases"}, newlines=True,
        )
        self.known: dict[str, str] = dict(self.language.char)
        self.known.update({" ": "", "\n": NEWLINE, "\r\n": NEWLINE, "\r": NEWLINE, _TPL_MARK: "t", _JSX_MARK: "x"})

    def _class(self, token: str) -> str:
        c = token[0]
        if c.isspace() or c == "\ufeff":
            if token.strip().startswith("/"):
                return "r"
            return NEWLINE if c in "\n\r\u2028\u2029" else ""
        if token.startswith("//"):
            return ""
        if token.startswith("/*"):
            return (NEWLINE if "\n" in token else "") if len(token) > 3 else ERROR
        if c in "\"'":
            return "s" if len(token) > 1 else ERROR
        if c.isdecimal() or (c == "." and len(token) > 1):
            return "n" if _NUMBER.fullmatch(token) or (self.script and token.isdecimal()) else ERROR
        if c == "/" and len(token) > 1:
            return "r"
        if c == ">":  # signs that touch: one operator, or the ends of nested type arguments
            return "g" * (len(token) - 1) + self.language.char[">"]
        return "i" if c.isalpha() or c in "_$\\" and len(token) > (c == "\\") else ERROR

    def tokens(self, text: str) -> str | None:
        """The token string; nothing if a token is broken."""
        text = self._outer(text)
        if text is None:
            return None
        known, out = self.known, []
        if len(known) > 300_000:
            self.known = known = {k: v for k, v in known.items() if len(k) < 4 or k in self.language.char}
        for token in _TOKEN.findall(text):
            c = known.get(token)
            if c is None:
                c = self._class(token)
                if len(token) < 40:
                    known[token] = c
            out.append(c)
        joined = "".join(out)
        return None if ERROR in joined else joined

    def _outer(self, text: str) -> str | None:
        """Replace templates and JSX elements by marks, after checking what they embed; nothing if one is broken."""
        if _TPL_MARK in text or _JSX_MARK in text:
            return None
        if "`" not in text and not (self.jsx and "<" in text):
            return text
        out, at, i = [], 0, 0
        while m := _SKIP.search(text, i):
            t, i = m.group(), m.end()
            if t == "`":
                end = self._template(text, m.start())
                if end < 0:
                    return None
                out += [text[at : m.start()], _TPL_MARK]
                at = i = end
            elif t[-1] == "<" and self.jsx:
                start = m.end() - 1
                end = self._element(text, start)
                if end >= 0:
                    out += [text[at:start], _JSX_MARK]
                    at = i = end
        out.append(text[at:])
        return "".join(out)

    def _embedded(self, text: str) -> bool:
        """Whether a text is an expression (or, in TypeScript, a type: templates are types too)."""
        got = self.tokens(text)
        folded = None if got is None else self.language.fold(got)
        return folded is not None and (self.language.matches("Expr", folded) or (self.ts and self.language.matches("Type", folded)))

    def _template(self, text: str, start: int) -> int:
        """The end of the template that starts here, -1 if it has none or embeds something invalid."""
        m = _TEMPLATE.match(text, start)
        if m:
            return m.end()
        i = start + 1
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1
            elif c == "$" and text.startswith("${", i):
                end = self._braces(text, i + 1)
                if end < 0 or not self._embedded(text[i + 2 : end - 1]):
                    return -1
                i = end
            else:
                i += 1
        return -1

    def _braces(self, text: str, start: int) -> int:
        """The end of the curly fragment that starts here, over strings, comments, templates and elements."""
        depth, i = 0, start
        while True:
            m = _SKIP.search(text, i)
            if m is None:
                return -1
            t, i = m.group(), m.end()
            if t == "{":
                depth += 1
            elif t == "}":
                depth -= 1
                if not depth:
                    return i
            elif t == "`":
                i = self._template(text, m.start())
                if i < 0:
                    return -1
            elif t[-1] == "<" and self.jsx:
                end = self._element(text, m.end() - 1)
                i = end if end >= 0 else i

    def _element(self, text: str, start: int) -> int:
        """The end of the JSX element that starts here, -1 if there is none."""
        open_: list[str] = []
        i = start
        while True:
            if text.startswith("</", i):
                i = _SPACE.match(text, i + 2).end()
                m = _JSX_NAME.match(text, i)
                name, i = (m.group(), m.end()) if m else ("", i)
                i = _SPACE.match(text, i).end()
                if not open_ or open_.pop() != name or text[i : i + 1] != ">":
                    return -1
                i += 1
                if not open_:
                    return i
            elif text.startswith("<", i):
                i = _SPACE.match(text, i + 1).end()
                m = _JSX_NAME.match(text, i)
                name, i = (m.group(), m.end()) if m else ("", i)
                while True:
                    i = _SPACE.match(text, i).end()
                    if text.startswith("/>", i) and name:
                        i += 2
                        if not open_:
                            return i
                        break
                    if text.startswith(">", i):
                        i += 1
                        open_.append(name)
                        break
                    if text.startswith("{", i) and name:
                        end = self._braces(text, i)
                        inner = text[i + 1 : end - 1].strip()
                        if end < 0 or not inner.startswith("...") or not self._embedded(inner[3:]):
                            return -1
                        i = end
                        continue
                    m = _JSX_NAME.match(text, i) if name else None
                    if not m:
                        return -1
                    i = _SPACE.match(text, m.end()).end()
                    if text.startswith("=", i):
                        i = _SPACE.match(text, i + 1).end()
                        if text[i : i + 1] in ('"', "'"):
                            i = text.find(text[i], i + 1) + 1
                            if not i:
                                return -1
                        elif text.startswith("{", i):
                            end = self._braces(text, i)
                            if end < 0 or not self._embedded(text[i + 1 : end - 1]):
                                return -1
                            i = end
                        elif text.startswith("<", i):
                            i = self._element(text, i)
                            if i < 0:
                                return -1
                        else:
                            return -1
            elif text.startswith("{", i):
                end = self._braces(text, i)
                if end < 0:
                    return -1
                inner = re.sub(r"/\*[\s\S]*?\*/|//[^\n]*\n", "", text[i + 1 : end - 1]).strip()
                if inner and not self._embedded(inner[3:] if inner.startswith("...") else inner):
                    return -1
                i = end
            else:
                m = _TEXT.match(text, i)
                if not m or re.search(r"[}>]", m.group()):
                    return -1
                i = m.end()

    def check(self, text: str) -> bool:
        text = text.lstrip("﻿")
        if text.startswith("#!"):
            text = "//" + text
        self.language.trim()
        return self._check(text) or (_SLASH_AFTER.search(text) is not None and self._check(_SLASH_AFTER.sub(_apart, text)))

    def _check(self, text: str) -> bool:
        got = self.tokens(text)
        folded = None if got is None else self.language.fold(got)
        if folded is None:
            return False
        leave = self.language.char["return"]
        if leave in folded and re.search(rf"(?:^|[\n;]){leave}", folded):
            return False  # a function's end outside of functions
        return self.language.matches("Stmts" if self.script else "TopStmts", folded)
