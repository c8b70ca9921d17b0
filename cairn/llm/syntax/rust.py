"""Rust."""

from __future__ import annotations

import re

from cairn.llm.syntax.engine import ERROR, Language

#: The language's strict and reserved keywords that are no names.
RESERVED = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type"
    " unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split()
)
_OPERATORS = "; , . .. ... ..= :: : -> => = + - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= >>= == != < > >= <= @ _ # $ ? ~"

_EXPR = """
Expr@ = 'return' Expr@? | 'break' LT?? Expr@? | 'continue' LT?? | Closure@ | Range@ (AsgOp Expr@)??
Range@ = Binary@ (('..' | '..=') Binary@?)? | ('..' | '..=') Binary@?
Binary@ = Unary@ (BinOp Unary@)* (BinOp Closure@)?
Closure@ = ('for' '<' LT (',' LT)** CLOSE)?? ('static' | 'async' | 'move' | 'const')** ('||' | '|' (ClosureParam (',' ClosureParam)** ','??)?? '|') ('->' TypeNB C[Block] | Expr@)
Unary@ = ('-' | '!' | '*' | '&' 'mut'?? | '&&' 'mut'?? | '&' 'raw' ('const' | 'mut'))* (Postfix@ ('as' TypeNB)** | 'let' Pat '=' Unary@ | 'return' Expr@? | 'break' LT?? | 'continue' LT??)
Postfix@ = Primary@ Suffix**
Primary@ = NUM | STR | CHAR | 'true' | 'false' | PathExpr '!' (P[*] | B[*] | C[*]) | PathExpr STRUCT | P[Tuple] | B[Array] | BlockExpr
"""
_GRAMMAR = """
File = InnerAttr** Item**
OneFn = Attr** Vis?? 'default'? FnHead (C[Block] | ';')
Items = InnerAttr** Item**
InnerAttr = '#' '!' B[*]
Attr = '#' B[*]
Vis = 'pub' P[*]?
Item = Attr** Vis?? (Fn | Struct | Enum | Trait | Impl | Use | Mod | Const | TypeAlias | Extern | MacroItem)
Fn = FnHead C[Block]
FnHead = ('const' | 'async' | 'unsafe' | 'extern' STR??)** 'fn' ID Generics?? P[FnParams] ('->' TypeNB)?? Where??
Generics = '<' (GenParam (',' GenParam)** ','??)?? CLOSE
GenParam = Attr** (LT (':' LT?? ('+' LT)**)?? | 'const' ID ':' Type ('=' (C[Block] | '-'?? NUM | ID))?? | ID (':' Bounds??)?? ('=' Type)??)
Where = 'where' (WherePred (',' WherePred)** ','??)??
WherePred = LT ':' Bounds?? | ForLt?? Type ':' Bounds??
ForLt = 'for' '<' (LT (',' LT)**)?? CLOSE
Bounds = Bound ('+' Bound)** '+'??
Bound = LT | ('?' | '~' 'const')?? ForLt?? Path | P[OneBound] | 'use' '<' (LT | ID) (',' (LT | ID))** CLOSE
OneBound = Bound
FnParams = (FnParam (',' FnParam)** ','??)??
FnParam = Attr** ('&' LT?? 'mut'?? 'self' | 'mut'?? 'self' (':' Type)?? | Pat ':' Type | Type | '...')
Struct = ('struct' | 'union') ID Generics?? (Where?? C[Fields] | P[TupleFields] Where?? ';' | Where?? ';')
Fields = (Field (',' Field)** ','??)??
Field = Attr** Vis?? ID ':' Type
TupleFields = (TupleField (',' TupleField)** ','??)??
TupleField = Attr** Vis? Type
Enum = 'enum' ID Generics?? Where?? C[Variants]
Variants = (Variant (',' Variant)** ','??)??
Variant = Attr** Vis?? ID (C[Fields] | P[TupleFields])?? ('=' Expr)??
Trait = 'unsafe'?? 'auto'? 'trait' ID Generics?? ((':' Bounds??)?? Where?? C[Assoc] | '=' Bounds Where?? ';')
Impl = 'default'? 'unsafe'?? 'impl' Generics? 'const'?? ('!'?? Path 'for')? TypeNB Where?? C[Assoc]
Assoc = InnerAttr** (Attr** Vis?? 'default'? (FnHead (C[Block] | ';') | Const | TypeAlias | MacroItem))**
Use = 'use' UseTree ';'
UseTree = ('::')?? (IDS '::')* (IDS ('as' (ID | '_'))?? | '*' | C[UseTrees])
UseTrees = (UseTree (',' UseTree)** ','??)??
IDS = ID | 'self' | 'super' | 'crate' | 'Self'
Mod = 'unsafe'?? 'mod' ID (';' | C[Items])
Const = ('const' | 'static' 'mut'??) (ID | '_') ':' Type ('=' Expr)?? ';'
TypeAlias = 'type' ID Generics?? (':' Bounds??)?? Where?? ('=' Type)?? Where?? ';'
Extern = 'extern' 'crate' IDS ('as' (ID | '_'))?? ';' | 'unsafe'?? 'extern' STR?? C[Foreign]
Foreign = InnerAttr** (Attr** Vis?? ('safe' | 'unsafe')? (FnHead ';' | 'static' 'mut'?? ID ':' Type ';' | 'type' ID ';' | MacroItem))**
MacroItem = Path '!' ID?? (C[*] | (P[*] | B[*]) ';') | 'macro' ID P[*]?? C[*]
Type = TypeNB ('+' Bound)**
TypeNB = ('&' | '&&') LT?? 'mut'?? TypeNB | '*' ('const' | 'mut') TypeNB | B[ArrayType] | P[TupleType] | ('impl' | 'dyn') Bounds | FnType | ForLt FnType | ForLt Path | Path ('!' (P[*] | B[*] | C[*]))?? | '!' | '_'
FnType = ('const' | 'unsafe' | 'extern' STR??)** 'fn' P[FnTypeParams] ('->' TypeNB)??
FnTypeParams = (FnTypeParam (',' FnTypeParam)** ','??)??
FnTypeParam = Attr** ((ID | '_') ':')? Type | '...'
ArrayType = Type (';' Expr)??
TupleType = (Type (',' Type)** ','??)??
Path = ('::')?? (PathSeg | '<' Type ('as' Path)?? CLOSE) ('::' PathSeg)**
PathSeg = IDS (('::')?? GenArgs | ('::')?? P[TupleType] ('->' TypeNB)??)?
GenArgs = '<' (GenArg (',' GenArg)** ','??)?? CLOSE
GenArg = LT | Type | ID GenArgs?? '=' Type | ID GenArgs?? ':' Bounds | '-'?? NUM | STR | CHAR | 'true' | 'false' | C[Block]
PathExpr = ('::')?? (IDS | '<' Type ('as' Path)?? CLOSE) ('::' (IDS | GenArgs))**
Block = InnerAttr** Stmt** (Attr** Expr)??
Stmts = InnerAttr** Stmt**
Stmt = ';' | Item | Attr** 'let' Pat (':' Type)?? ('=' Expr ('else' C[Block])??)?? ';' | Attr** Block1 | Attr** PathExpr '!' C[*] | Attr** Expr ';'
Block1 = BlockExpr
BlockExpr = 'unsafe'?? C[Block] | 'async' 'move'?? C[Block] | 'const' C[Block] | (LT ':')?? ('loop' C[Block] | 'while' ExprH C[Block] | 'for' Pat 'in' ExprH C[Block] | C[Block]) | If | 'match' ExprH C[Arms]
If = 'if' ExprH C[Block] ('else' (If | C[Block]))??
Arms = InnerAttr** (Arm ',' | BlockArm)** Arm??
Arm = Attr** Pat ('if' ExprArm)?? '=>' Expr
BlockArm = Attr** Pat ('if' ExprArm)?? '=>' BlockExpr
ExprArm = Expr
CLOSE = '>' | ADJ
BinOp = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '<<' | ADJ '>' | '>' | '<' | '==' | '!=' | '>=' | '<='
AsgOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>>='
ClosureParam = Attr** PatNo (':' Type)??
Suffix = '?' | '.' (ID ('::' GenArgs)?? | NUM | 'await') | P[Args] | B[OneExpr]
OneExpr = Expr
Args = (Attr** Expr (',' Attr** Expr)** ','??)??
Tuple = (Attr** Expr (',' Expr)** ','??)??
Array = (Expr (';' Expr | (',' Expr)** ','??))??
StructLit = (FieldInit (',' FieldInit)** ','??)?? ('..' Expr??)??
FieldInit = Attr** ((ID | NUM) ':' Expr | ID)
Pat = '|'?? PatNo ('|' PatNo)**
PatNo = PatLow ('..=' PatLow | '...' PatLow | '..' PatLow?)? | ('..' | '..=') PatLow? | ('&' | '&&') 'mut'?? PatNo | 'ref'?? 'mut'?? ID ('@' PatNo)?? | 'box' PatNo | '_' | P[Pats] | B[Pats] | 'const' C[Block]
PatLow = '-'?? NUM | STR | CHAR | 'true' | 'false' | PathExpr (P[Pats] | C[FieldPats] | '!' (P[*] | B[*] | C[*]))?
Pats = (Attr** Pat (',' Pat)** ','??)??
FieldPats = (FieldPat (',' FieldPat)** ','??)??
FieldPat = Attr** ((ID | NUM) ':' Pat | 'ref'?? 'mut'?? ID | '..')
"""
_TOKEN = re.compile(
    r"[\s﻿‎‏]+|(?:b|c)?r(#*)\"[\s\S]*?\"\1|(?:b|c)?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))'"
    r"|'[^\W\d]\w*|r#[^\W\d]\w*|[^\W\d]\w*|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"
    r"|(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![._]|[^\W\d])[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[^\W\d]\w*)?"
    r"|<<=|>>=|>{2,}|\.\.\.|\.\.=|\.\.|::|->|=>|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|==|!=|>=|<=|<<|[\s\S]"
)
_NUMBER = re.compile(r"(?:0x[0-9a-fA-F_]*[0-9a-fA-F]_*|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?")


class Rust:
    """``check(text)`` tells whether a text is a valid file."""

    top = "File"

    def __init__(self) -> None:
        grammar = _GRAMMAR + "".join(_EXPR.replace("PathExpr STRUCT", s).replace("@", v) for v, s in (("", "PathExpr (C[StructLit])?"), ("H", "PathExpr")))
        self.language = Language(
            grammar, RESERVED,
            {
                "P": ("FnParams", "TupleFields", "TupleType", "FnTypeParams", "OneBound", "Args", "Tuple", "Pats"),
                "B": ("ArrayType", "OneExpr", "Array", "Pats"),
                "C": ("Block", "Fields", "Variants", "Assoc", "UseTrees", "Items", "Foreign", "Arms", "StructLit", "FieldPats"),
            },
            _OPERATORS, {"NUM": "n", "STR": "s", "CHAR": "c", "LT": "l", "ADJ": "g"}, {"Block": "Stmts"},
        )
        self.known = dict(self.language.char)

    def _class(self, token: str) -> str:
        c = token[0]
        if c.isspace() or c in "﻿‎‏" or token.startswith("//"):
            return ""
        if token.startswith("/*"):
            return "" if len(token) > 3 else ERROR
        if token[-1] == '"' or (token[-1] == "#" and '"' in token):
            return "s" if len(token) > 1 else ERROR
        if c == "'" or token.startswith("b'"):
            return ERROR if len(token) < 2 else "c" if token[-1] == "'" else "l"
        if c.isdecimal():
            return "n" if _NUMBER.fullmatch(token) else ERROR
        if c == ">":  # signs that touch: an operator, or the ends of nested arguments
            return "g" * (len(token) - 1) + self.language.char[">"]
        return "i" if c.isalpha() or c == "_" else ERROR

    def tokens(self, text: str) -> str | None:
        """The token string; nothing if a token is broken."""
        known, out = self.known, []
        if len(known) > 300_000:
            self.known = known = dict(self.language.char)
        for m in _TOKEN.finditer(text):
            token = m.group()
            c = known.get(token)
            if c is None:
                c = self._class(token)
                if len(token) < 40:
                    known[token] = c
            out.append(c)
        joined = "".join(out)
        return None if ERROR in joined else joined

    def check(self, text: str) -> bool:
        text = text.lstrip("﻿")
        if text.startswith("#!") and not text[2:].lstrip().startswith("["):
            text = "//" + text
        got = self.tokens(text)
        folded = None if got is None else self.language.fold(got)
        self.language.trim()
        return folded is not None and self.language.matches(self.top, folded)
