"""Go."""

from __future__ import annotations

import re

from cairn.llm.syntax.engine import ERROR, Language

#: The language's keywords.
RESERVED = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
_OPERATORS = "; , . ... : := = + - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == != < <= > >= ! ~"

_EXPR = """
Expr@ = Unary@ (BinOp Unary@)**
Unary@ = ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')** Postfix@
Postfix@ = Primary@ Suffix@*
Suffix@ = '.' (ID | P[Assertion]) | P[Args] | B[Index] COMPOSITE
"""
_GRAMMAR = """
File = 'package' ID ';' (Import ';')** (TopDecl ';')** TopDecl??
Import = 'import' (ImportSpec | P[ImportSpecs])
ImportSpecs = (ImportSpec?? ';')** ImportSpec??
ImportSpec = (ID | '.')?? STR
TopDecl = Decl | 'func' P[Params]?? ID B[TypeParams]?? P[Params] Result?? C[Block]??
Decl = 'const' (ConstSpec | P[ConstSpecs]) | 'var' (VarSpec | P[VarSpecs]) | 'type' (TypeSpec | P[TypeSpecs])
ConstSpecs = (ConstSpec?? ';')** ConstSpec??
ConstSpec = Ids (Type?? '=' Exprs)??
VarSpecs = (VarSpec?? ';')** VarSpec??
VarSpec = Ids (Type ('=' Exprs)?? | '=' Exprs)
TypeSpecs = (TypeSpec?? ';')** TypeSpec??
TypeSpec = ID (B[TypeParams])? '='?? Type
TypeParams = ID (',' ID)** Constraint (',' ID (',' ID)** Constraint)** ','??
Constraint = '~'?? Type ('|' '~'?? Type)**
Ids = ID (',' ID)**
Exprs = Expr (',' Expr)**
Result = P[Params] | Type
Params = (Param (',' Param)** ','??)??
Param = ID ('...')?? Type | ('...')?? Type
Type = ID ('.' ID)?? (B[TypeArgs])? | '*' Type | B[Length] Type | 'struct' C[Fields] | 'interface' C[Methods] | 'map' B[OneType] Type | 'chan' '<-'?? Type | '<-' 'chan' Type
  | 'func' P[Params] Result? | P[OneType]
OneType = Type
Length = ('...' | Expr)??
TypeArgs = Type (',' Type)** ','??
Fields = (Field?? ';')** Field??
Field = (Ids Type | '*'?? ID ('.' ID)?? B[TypeArgs]?) STR??
Methods = (Method?? ';')** Method??
Method = ID P[Params] Result?? | Constraint
Block = (Stmt?? ';')** Stmt??
Stmt = Decl | Label | Simple | 'go' Expr | 'defer' Expr | 'return' Exprs?? | 'break' ID?? | 'continue' ID?? | 'goto' ID | 'fallthrough' | C[Block] | If | For | Switch | Select
Label = ID ':' Stmt??
Simple = Exprs (('=' | ':=' | AsgOp) Exprs | '++' | '--' | '<-' Expr)?
SimpleH = ExprH (',' ExprH)** (('=' | ':=' | AsgOp) ExprH (',' ExprH)** | '++' | '--' | '<-' ExprH)?
AsgOp = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
If = 'if' (SimpleH?? ';')? ExprH C[Block] ('else' (If | C[Block]))??
For = 'for' (ExprH | SimpleH?? ';' ExprH?? ';' SimpleH?? | (ExprH (',' ExprH)** ('=' | ':='))?? 'range' ExprH)? C[Block]
Switch = 'switch' (SimpleH?? ';')? (SimpleH | ID ':=' PostfixH | ExprH)? C[Cases]
Cases = (('case' (Expr | Type) (',' (Expr | Type))** | 'default') ':' Block)** 
Select = 'select' C[Comms]
Comms = (('case' Simple | 'default') ':' Block)**
BinOp = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>='
Assertion = 'type' | Type
Args = ((Expr | Type) (',' (Expr | Type))** ('...')?? ','??)??
Index = (Expr | Type) (',' (Expr | Type))** ','?? | Expr?? ':' Expr?? (':' Expr)??
Paren = Expr | Type
Elements = (Element (',' Element)** ','??)??
Element = (Expr | C[Elements]) (':' (Expr | C[Elements]))??
"""
_PRIMARY = """
Primary@ = ID | NUM | STR | CHAR | P[Paren] | 'func' P[Params] Result?? C[Block] | B[Length] Type (P[Args] | C[Elements]) | 'map' B[OneType] Type (P[Args] | C[Elements])?? | 'struct' C[Fields] (C[Elements])?? | 'chan' Type | 'interface' C[Methods]
"""
_TOKEN = re.compile(
    r"[ \t\r﻿]+|\n|[^\W\d]\w*|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
    r"|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"
    r"|(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?:[^\W\d]\w*)?"
    r"|<<=|>>=|&\^=|\.\.\.|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|<<|>>|&\^|[\s\S]"
)
_NUMBER = re.compile(r"(?:0[xX]_?[0-9a-fA-F][0-9a-fA-F_]*|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?|0[xX][0-9a-fA-F_.]+[pP][+-]?\d+)i?")


class Go:
    """``check(text)`` tells whether a text is a valid file."""

    top = "File"

    def __init__(self) -> None:
        grammar = _GRAMMAR + "".join((_EXPR + _PRIMARY).replace("COMPOSITE", c).replace("@", v) for v, c in (("", "| C[Elements]"), ("H", "")))
        self.language = Language(
            grammar, RESERVED,
            {
                "P": ("ImportSpecs", "ConstSpecs", "VarSpecs", "TypeSpecs", "Params", "OneType", "Assertion", "Args", "Paren"),
                "B": ("TypeParams", "TypeArgs", "OneType", "Length", "Index"),
                "C": ("Block", "Fields", "Methods", "Cases", "Comms", "Elements"),
            },
            _OPERATORS, {"NUM": "n", "STR": "s", "CHAR": "c"}, {"Block": "Block"},
        )
        self.known = dict(self.language.char) | {"\n": "\n"}
        char = self.language.char
        ends = "insc)]}" + "".join(char[w] for w in ("break", "continue", "fallthrough", "return", "++", "--"))
        self.line_end = re.compile(rf"(?<=[{re.escape(ends)}])\n+")
        self.before_close = re.compile(rf"{re.escape(char[';'])}(?=[)}}])")

    def _class(self, token: str) -> str:
        c = token[0]
        if c in " \t\r﻿" or token.startswith("//"):
            return ""
        if token.startswith("/*"):
            return ("\n" if "\n" in token else "") if len(token) > 3 else ERROR
        if c in '"`':
            return "s" if len(token) > 1 else ERROR
        if c == "'":
            return "c" if len(token) > 1 else ERROR
        if c.isdecimal() or (c == "." and len(token) > 1):
            return "n" if _NUMBER.fullmatch(token) else ERROR
        return "i" if c.isalpha() or c == "_" else ERROR

    def tokens(self, text: str) -> str | None:
        """The token string with the semicolons that line ends stand for; nothing if a token is broken."""
        known, out = self.known, []
        if len(known) > 300_000:
            self.known = known = dict(self.language.char) | {"\n": "\n"}
        for token in _TOKEN.findall(text + "\n"):
            c = known.get(token)
            if c is None:
                c = self._class(token)
                if len(token) < 40:
                    known[token] = c
            out.append(c)
        joined = "".join(out)
        if ERROR in joined:
            return None
        return self.line_end.sub(self.language.char[";"], joined).replace("\n", "")

    def check(self, text: str) -> bool:
        got = self.tokens(text.lstrip("﻿"))
        folded = None if got is None else self.language.fold(got)
        self.language.trim()
        return folded is not None and self.language.matches(self.top, folded)
