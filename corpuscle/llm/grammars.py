"""Grammars of JavaScript, TypeScript, Go, Java and JSON for :mod:`corpuscle.llm.peg`; that of Python is in :mod:`.pysyntax`.

They recognise; precedence is not needed for that, so operator chains are flat.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from corpuscle.functions import lexing as L
from corpuscle.functions.lexing import END, partners
from corpuscle.llm import lexers as X
from corpuscle.llm import pysyntax as P
from corpuscle.llm.peg import Grammar, allow_nesting

_ECMA = """
Program <- Stmt* END
Stmt <- ';' / Block / VarDecl / Func / Class / If / For / While / Do / Switch / Try / Return / Throw / Jump / Import / Export / Ts / Debugger / With / Decorator+ ('export' 'default'?)? TsAbstract? Class / Labeled / ExprStmt
@group Block <- '{' Stmt* '}'
Semi <- ';' / &'}' / NL
VarDecl <- 'const' !'enum' ConstDecl (',' ConstDecl)* Semi / ('var' / 'let' &(ID / '{' / '[')) Declarator (',' Declarator)* Semi
ConstDecl <- Binding TypeAnn? '=' Assign / TsAmbient
Declarator <- Binding Definite? TypeAnn? ('=' Assign)?
Binding <- ID / ObjPat / ArrPat
@group ObjPat <- '{' (ObjPatEl (',' ObjPatEl)* ','?)? '}'
ObjPatEl <- '...' Binding / PropName ':' Target / ID ('=' Assign)?
@group ArrPat <- '[' (',' / '...' Binding / Target (',' / &']'))* ']'
Target <- (Binding / Lhs) ('=' Assign)?
Func <- 'async'? 'function' '*'? ID TypeParams? Params RetAnn? (Block / TsBodyless)
FuncExpr <- 'async'? 'function' '*'? ID? TypeParams? Params RetAnn? Block
@group Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- Decorator* ParamMod* '...'? (Binding / ThisParam) Optional? TypeAnn? ('=' Assign)?
Class <- 'class' (!'implements' ID)? TypeParams? ('extends' Lhs TypeArgs?)? TsImplements? ClassBody
@group ClassBody <- '{' Member* '}'
Member <- ';' / 'static' Block / Decorator* Mod* (TsIndex Semi / '*'? PropName (Optional / Definite)? (TypeParams? Params RetAnn? (Block / TsBodyless) / TypeAnn? ('=' Assign)? Semi))
Mod <- MODWORD !('(' / '=' / ';' / ':' / '?' / '}' / ',' / '<' / '!')
Decorator <- '@' Lhs
PropName <- WORD / STR / NUM / Computed
@group Computed <- '[' Assign ']'
If <- 'if' Paren Stmt ('else' Stmt)?
For <- 'for' 'await'? ForHead Stmt
@group ForHead <- '(' ((('var' / 'let' / 'const') Declarator (',' Declarator)* / Expr)? ';' Expr? ';' Expr? / (('var' / 'let' / 'const') Binding / Lhs) ('of' / 'in') Expr) ')'
While <- 'while' Paren Stmt
Do <- 'do' Stmt 'while' Paren ';'?
With <- 'with' Paren Stmt
@group Paren <- '(' Expr ')'
Switch <- 'switch' Paren SwitchBody
@group SwitchBody <- '{' (('case' Expr / 'default') ':' Stmt*)* '}'
Try <- 'try' Block ('catch' CatchHead? Block ('finally' Block)? / 'finally' Block)
@group CatchHead <- '(' Binding TypeAnn? ')'
Return <- 'return' (!NL Expr)? Semi
Throw <- 'throw' !NL Expr Semi
Jump <- ('break' / 'continue') (!NL ID)? Semi
Debugger <- 'debugger' Semi
Labeled <- ID ':' Stmt
ExprStmt <- !'{' !'function' !'class' Expr Semi
Import <- 'import' (STR / ('type' !'from')? ImportClause 'from' STR / TsImportEq) (('with' / ID) Object)? Semi
ImportClause <- ID (',' (Names / Star))? / Names / Star
Star <- '*' 'as' ID
@group Names <- '{' (Name (',' Name)* ','?)? '}'
Name <- ('type' !('as' / ',' / '}'))? (WORD / STR) ('as' (WORD / STR))?
Export <- 'export' ('default' (FuncExpr / TsAbstract? Class / Ts / Assign Semi) / '*' ('as' (WORD / STR))? 'from' STR Semi / 'type'? Names ('from' STR)? Semi / VarDecl / Func / Decorator* Class / Ts / TsExportEq)
Expr <- Assign (',' Assign)*
Assign <- Arrow / Yield / Cond (AssignOp Assign)?
AssignOp <- '=' / ASSIGN / '>' '>'? '>='
Yield <- 'yield' ('*' Assign / (!NL Assign)?)
Arrow <- 'async'? (!NL ID '=>' / TypeParams? ARROW Params RetAnn? '=>' / ID '=>') (Block / Assign)
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- Unary (TsCast / BinOp Unary)*
BinOp <- BIN / '>' '>'? '>'? / 'in' / 'instanceof'
Unary <- (('!' / '~' / '+' / '-' / '++' / 'typeof' / 'void' / 'delete') / 'await' &OPERAND)* Lhs (!NL '++')?
Lhs <- ('new' !'.')* Primary Suffix*
Suffix <- '.' WORD / '?.' (WORD / Index / Args / TPL) / Index / Args / TPL / TsSuffix
@group Index <- '[' Expr ']'
@group Args <- '(' ('...'? Assign (',' '...'? Assign)* ','?)? ')'
Primary <- 'async' &'function' FuncExpr / ID / NUM / STR / TPL / REGEX / JSX / 'this' / 'super' / 'null' / 'true' / 'false' / Paren / Array / Object / FuncExpr / Decorator* Class / 'import' (Args / '.' WORD) / 'new' '.' WORD / TsAssert
@group Array <- '[' (',' / '...'? Assign (',' / &']'))* ']'
@group Object <- '{' (Prop (',' Prop)* ','?)? '}'
Prop <- '...' Assign / PropName ':' Assign / (MODWORD !('(' / ':' / ',' / '}' / '='))* '*'? PropName TypeParams? Params RetAnn? Block / ID ('=' Assign)?
"""

_JS_ONLY = """
TypeAnn <- NEVER
RetAnn <- NEVER
TypeParams <- NEVER
TypeArgs <- NEVER
Optional <- NEVER
Definite <- NEVER
ThisParam <- NEVER
ParamMod <- NEVER
Ts <- NEVER
TsAbstract <- NEVER
TsBodyless <- NEVER
TsAmbient <- NEVER
TsImplements <- NEVER
TsIndex <- NEVER
TsImportEq <- NEVER
TsExportEq <- NEVER
TsCast <- NEVER
TsSuffix <- NEVER
TsAssert <- NEVER
"""

_TS_ONLY = """
TypeAnn <- ':' Type
RetAnn <- ':' ('asserts' (ID / 'this') ('is' Type)? / (ID / 'this') 'is' Type / Type)
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in')? (ID &ID)? ID ('extends' Type)? ('=' Type)?
TypeArgs <- '<' Type (',' Type)* '>'
Optional <- '?'
Definite <- '!'
ThisParam <- 'this'
ParamMod <- MODWORD !(':' / ',' / ')' / '=' / '?')
Ts <- Interface / Alias / Enum / Module / Declare / TsAbstract Class
TsAbstract <- 'abstract'
TsBodyless <- Semi
TsAmbient <- Binding TypeAnn
TsImplements <- 'implements' Type (',' Type)*
TsIndex <- '[' ID ':' Type ']' TypeAnn
TsImportEq <- 'type'? ID '=' Expr
TsExportEq <- '=' Expr Semi / 'as' 'namespace' ID Semi
TsCast <- ('as' / 'satisfies') (Type / 'const')
TsSuffix <- !NL '!' / TypeArgs &('(' / TPL) Args?
TsAssert <- '<' Type '>' Unary
Interface <- 'interface' ID TypeParams? ('extends' Type (',' Type)*)? TypeBody
Alias <- 'type' ID TypeParams? '=' Type Semi
Enum <- 'const'? 'enum' ID EnumBody
@group EnumBody <- '{' (PropName ('=' Assign)? (',' / &'}'))* '}'
Module <- ('namespace' / 'module') !NL (ID ('.' ID)* / STR) (Block / Semi)
Declare <- 'declare' ('global' Block / ('const' / 'let' / 'var') Declarator (',' Declarator)* Semi / Func / TsAbstract? Class / Ts / 'const' Enum)
Type <- FuncType / Union ('extends' Union '?' Type ':' Type)?
FuncType <- ('abstract'? 'new')? TypeParams? TYPEARROW Params '=>' RetType
RetType <- 'asserts' (ID / 'this') ('is' Type)? / (ID / 'this') 'is' Type / Type
Union <- ('|' / '&')? Post (('|' / '&') Post)*
Post <- (('keyof' / 'readonly' / 'infer' / 'unique') &TYPESTART / 'typeof')* Prim (!NL ('[' Type? ']'))*
Prim <- ParenType / TypeBody / Tuple / STR / '-'? NUM / TPL / 'null' / 'true' / 'false' / 'void' / 'this' / 'import' Args ('.' WORD)* TypeArgs? / ID ('.' WORD)* TypeArgs?
@group ParenType <- '(' Type ')'
@group Tuple <- '[' (('...'? (WORD '?'? ':')? '...'? Type '?'?) (',' / &']'))* ']'
@group TypeBody <- '{' (TypeMember (';' / ',' / NL / &'}'))* '}'
TypeMember <- ('-' / '+')? (MODWORD !('(' / ':' / '?' / ';' / ',' / '}' / '<'))* ('[' ID 'in' Type ('as' Type)? ']' (('-' / '+')? '?')? TypeAnn? / '[' ID ':' Type ']' TypeAnn / 'new'? TypeParams? Params RetAnn? / PropName '?'? (TypeParams? Params RetAnn? / TypeAnn?))
"""

_GO = """
File <- 'package' ID ';' (Import ';')* (Top ';')* END
Import <- 'import' (ImportSpec / ImportList)
@group ImportList <- '(' (ImportSpec (';' ImportSpec)* ';'?)? ')'
ImportSpec <- ('.' / ID)? STR
Top <- Func / Decl
Func <- 'func' Params? ID TypeParams? Sig Block?
TypeParams <- '[' ID (',' ID)* Constraint (',' ID (',' ID)* Constraint)* ','? ']'
Constraint <- '~'? Type ('|' '~'? Type)*
Sig <- Params (Params / Type)?
@group Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- ID '...'? Type / '...'? Type
Decl <- 'const' (ConstSpec / ConstList) / 'var' (VarSpec / VarList) / 'type' (TypeSpec / TypeList)
@group ConstList <- '(' (ConstSpec (';' ConstSpec)* ';'?)? ')'
ConstSpec <- ID (',' ID)* (Type? '=' Exprs)?
@group VarList <- '(' (VarSpec (';' VarSpec)* ';'?)? ')'
VarSpec <- ID (',' ID)* ('=' Exprs / Type ('=' Exprs)?)
@group TypeList <- '(' (TypeSpec (';' TypeSpec)* ';'?)? ')'
TypeSpec <- ID (TypeParams Type / '='? Type)
Type <- '*' Type / '[' ('...' / Expr)? ']' Type / 'map' '[' Type ']' Type / 'chan' '<-'? Type / '<-' 'chan' Type / 'func' Sig / Struct / Iface / ParenType / ID ('.' ID)? TypeArgs?
@group TypeArgs <- '[' Type (',' Type)* ']'
@group ParenType <- '(' Type ')'
Struct <- 'struct' StructBody
@group StructBody <- '{' (Field (';' Field)* ';'?)? '}'
Field <- (ID (',' ID)* Type / '*'? ID ('.' ID)? TypeArgs?) STR?
Iface <- 'interface' IfaceBody
@group IfaceBody <- '{' ((ID Sig / Constraint) (';' (ID Sig / Constraint))* ';'?)? '}'
@group Block <- '{' Stmts '}'
Stmts <- Stmt? (';' Stmt?)*
Stmt <- Decl / Labeled / Block / If / For / Switch / Select / 'return' Exprs? / ('break' / 'continue' / 'goto') ID? / 'fallthrough' / ('go' / 'defer') Expr / Simple
Labeled <- ID ':' Stmt?
Simple <- Exprs ((':=' / '=' / ASSIGN) Exprs / '++' / '<-' Expr)?
SimpleN <- ExprsN ((':=' / '=' / ASSIGN) ExprsN / '++' / '<-' ExprN)?
If <- 'if' (SimpleN? ';')? ExprN Block ('else' (If / Block))?
For <- 'for' (Block / (ExprsN (':=' / '='))? 'range' ExprN Block / SimpleN? ';' ExprN? ';' SimpleN? Block / ExprN Block)
Switch <- 'switch' (SimpleN? ';')? SimpleN? SwitchBody
@group SwitchBody <- '{' (('case' Types / 'default') ':' Stmts)* '}'
Types <- CaseItem (',' CaseItem)*
CaseItem <- Type &(',' / ':') / Expr
Select <- 'select' SelectBody
@group SelectBody <- '{' (('case' Simple / 'default') ':' Stmts)* '}'
Exprs <- Expr (',' Expr)*
ExprsN <- ExprN (',' ExprN)*
Expr <- Unary (BinOp Unary)*
ExprN <- UnaryN (BinOp UnaryN)*
BinOp <- BIN / '+' / '-' / '*' / '&' / '^' / '|'
PREFIX <- '+' / '-' / '!' / '^' / '*' / '&' / '<-'
Unary <- PREFIX* Operand (Suffix / Literal)*
UnaryN <- PREFIX* OperandN Suffix*
Operand <- 'func' Sig Block / NUM / STR / LitType Literal / Conversion / ID / Paren
OperandN <- 'func' Sig Block / NUM / STR / LitType Literal / Conversion / ID / Paren
LitType <- '[' ('...' / Expr)? ']' Type / 'map' '[' Type ']' Type / Struct
Conversion <- ('[' ']' Type / 'map' '[' Type ']' Type / 'chan' Type / Iface) &'('  / 'chan' Type / 'map' '[' Type ']' Type / '[' Expr? ']' Type / Iface / Struct
@group Paren <- '(' (Expr / Type) ')'
@group Literal <- '{' (Element (',' Element)* ','?)? '}'
Element <- (Literal / Expr) (':' (Literal / Expr))?
Suffix <- '.' (ID / TypeAssert) / IndexOrSlice / Args
@group TypeAssert <- '(' ('type' / Type) ')'
@group IndexOrSlice <- '[' (Expr? ':' Expr? (':' Expr)? / (Expr / Type) (',' Type)* ','?) ']'
@group Args <- '(' ((Expr / Type) (',' (Expr / Type))* '...'? ','?)? ')'
"""

_JAVA = """
Unit <- (Annot* 'package' QName ';')? (Import / ';')* (TypeDecl / ';')* END
Import <- 'import' 'static'? QName ('.' '*')? ';'
QName <- ID ('.' ID)*
TypeDecl <- Mod* (ClassDecl / IfaceDecl / EnumDecl / RecordDecl / AnnotDecl)
Mod <- MODWORD / 'sealed' &(MODWORD / 'class' / 'interface') / 'non' '-' 'sealed' / Annot
Annot <- '@' !'interface' QName AnnotArgs?
@group AnnotArgs <- '(' (AnnotItem (',' AnnotItem)*)? ')'
AnnotItem <- ID '=' AnnotValue / AnnotValue
AnnotValue <- Annot / AnnotArray / Cond
@group AnnotArray <- '{' (AnnotValue (',' AnnotValue)*)? ','? '}'
ClassDecl <- 'class' ID TypeParams? ('extends' Type)? ('implements' Type (',' Type)*)? ('permits' Type (',' Type)*)? ClassBody
RecordDecl <- 'record' ID TypeParams? Params ('implements' Type (',' Type)*)? ClassBody
IfaceDecl <- 'interface' ID TypeParams? ('extends' Type (',' Type)*)? ('permits' Type (',' Type)*)? ClassBody
AnnotDecl <- '@' 'interface' ID ClassBody
EnumDecl <- 'enum' ID ('implements' Type (',' Type)*)? EnumBody
@group EnumBody <- '{' (EnumConst (',' EnumConst)*)? ','? (';' Member*)? '}'
EnumConst <- Annot* ID Args? ClassBody?
@group ClassBody <- '{' Member* '}'
Member <- ';' / 'static'? Block / Mod* (ClassDecl / IfaceDecl / EnumDecl / RecordDecl / AnnotDecl / TypeParams? ID Params Throws Block / ID Block / TypeParams? Type ID (Params Dim* Throws ('default' AnnotValue)? (Block / ';') / Vars ';'))
Throws <- ('throws' Type (',' Type)*)?
@group Params <- '(' (Param (',' Param)*)? ')'
Param <- Mod* Type Annot* '...'? (ID '.')? (ID / 'this') Dim*
Dim <- '[' ']'
Vars <- Dim* ('=' VarInit)? (',' ID Dim* ('=' VarInit)?)*
VarInit <- ArrayInit / Expr
@group ArrayInit <- '{' (VarInit (',' VarInit)*)? ','? '}'
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- Annot* ID ('extends' Type ('&' Type)*)?
Type <- Annot* (PRIMITIVE / ID TypeArgs? ('.' Annot* ID TypeArgs?)*) (Annot* Dim)*
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- Annot* '?' (('extends' / 'super') Type)? / Type
@group Block <- '{' Stmt* '}'
Stmt <- Block / ';' / If / For / While / Do / Switch / Try / 'return' Expr? ';' / 'throw' Expr ';' / ('break' / 'continue') ID? ';' / 'yield' !('=' / '.' / '++' / ASSIGN / ')') Expr ';' / 'assert' Expr (':' Expr)? ';' / 'synchronized' Paren Block / Labeled / LocalType / LocalVar ';' / Expr ';'
Labeled <- ID ':' Stmt
LocalType <- Mod* (ClassDecl / IfaceDecl / EnumDecl / RecordDecl)
LocalVar <- Mod* Type ID Vars
If <- 'if' Paren Stmt ('else' Stmt)?
While <- 'while' Paren Stmt
Do <- 'do' Stmt 'while' Paren ';'
For <- 'for' ForHead Stmt
@group ForHead <- '(' (Mod* Type ID ':' Expr / (LocalVar / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)?) ')'
Switch <- 'switch' Paren SwitchBody
@group SwitchBody <- '{' (('case' CaseLabel (',' CaseLabel)* ('when' Expr)? / 'default') (':' Stmt* / '->' (Block / 'throw' Expr ';' / Expr ';')))* '}'
CaseLabel <- 'default' / Pattern / Cond
Pattern <- Mod* Type (PatternList ID? / ID)
@group PatternList <- '(' (Pattern (',' Pattern)*)? ')'
Try <- 'try' Resources? Block (Catch+ ('finally' Block)? / 'finally' Block)? 
@group Resources <- '(' Resource (';' Resource)* ';'? ')'
Resource <- Mod* Type ID '=' Expr / Expr
Catch <- 'catch' CatchHead Block
@group CatchHead <- '(' Mod* Type ('|' Type)* ID ')'
@group Paren <- '(' Expr ')'
Expr <- Lambda / Cond (AssignOp Expr)?
AssignOp <- '=' / ASSIGN / '>' '>'? '>='
Lambda <- (ID '->' / LAMBDA LambdaParams '->') (Block / Expr)
@group LambdaParams <- '(' (ID (',' ID)* / Param (',' Param)*)? ')'
Cond <- Binary ('?' (Lambda / Cond) ':' (Lambda / Cond))?
Binary <- Unary (BinOp Unary / 'instanceof' (Pattern / 'final'? Type))*
BinOp <- BIN / '>' '>'? '>'?
Unary <- ('+' / '-' / '!' / '~' / '++') Unary / Cast / Postfix
@group CastHead <- '(' Type ('&' Type)* ')'
Cast <- CastHead &(ID / NUM / STR / '(' / '!' / '~' / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / PRIMITIVE / 'switch' / '+' / '-') (Lambda / Unary)
Postfix <- Primary Suffix* '++'*
Primary <- NUM / STR / 'true' / 'false' / 'null' / 'this' Args? / 'super' Args? / New / SwitchExpr / Paren / GenericRef / ID / PRIMITIVE Dim* ('.' 'class' / '::' ('new' / ID)) / 'void' '.' 'class'
GenericRef <- ID TypeArgs? ('.' ID TypeArgs?)* Dim* '::' ('new' / ID) / ID ('.' ID)* Dim+ '.' 'class'
SwitchExpr <- Switch
New <- 'new' Annot* TypeArgs? (PRIMITIVE / ID TypeArgs? ('.' ID TypeArgs?)*) (Dim+ ArrayInit / ArrayDim+ Dim* / Args ClassBody?)
@group ArrayDim <- '[' Expr ']'
Suffix <- '.' ('new' ID TypeArgs? Args ClassBody? / 'class' / 'this' / 'super' Args? / TypeArgs? ID) / Index / Args / '::' TypeArgs? (ID / 'new')
@group Index <- '[' Expr ']'
@group Args <- '(' (Expr (',' Expr)*)? ')'
"""

_JSON = """
Text <- Value END
Value <- Object / Array / STR / NUM / WORD
@group Object <- '{' (STR ':' Value (',' STR ':' Value)*)? '}'
@group Array <- '[' (Value (',' Value)*)? ']'
"""

#: Words that may stand before a member's name.
_JS_MODS = "static async get set public private protected readonly abstract declare override accessor".split()
_JAVA_MODS = "abstract final native private protected public static strictfp synchronized transient volatile default".split()
_JAVA_PRIMITIVES = "boolean byte char double float int long short void".split()


@cache
def grammar(language: str) -> Grammar:
    """The compiled grammar of a language, built once in a process."""
    if language in ("javascript", "typescript"):
        lits = L._JS_OPS | L.JS_KINDS
        lits |= {"++": "U", ">=": "G"}
        words = "".join(L.JS_KINDS.values())
        ident = "i" + "".join(L.JS_KINDS[w] for w in L.JS_CONTEXT)
        classes = {"ID": ident, "WORD": "i" + words, "STR": "s", "NUM": "n", "TPL": "t", "REGEX": "r", "JSX": "x", "ASSIGN": "A", "BIN": "BG+-*|&<", "MODWORD": "".join(L.JS_KINDS[w] for w in _JS_MODS), "OPERAND": ident + "snrtx([{!~+-U" + "".join(L.JS_KINDS[w] for w in "new this function class super null true false typeof void delete await import".split()), "TYPESTART": ident + "sn([{t" + "".join(L.JS_KINDS[w] for w in "null true false void this typeof".split()), "NEVER": "\1"}
        ts = language == "typescript"
        after = "K[M[{0}] + 1] in 'F:'" if ts else "K[M[{0}] + 1] == 'F'"
        special = {"NL": "N[{0}] == '1'", "END": f"K[{{0}}] == {END!r}", "ARROW": "K[{0}] == '(' and M[{0}] >= 0 and " + after, "TYPEARROW": "K[{0}] == '(' and M[{0}] >= 0 and K[M[{0}] + 1] == 'F'"}
        return Grammar(_ECMA + (_TS_ONLY if ts else _JS_ONLY), lits, classes, special)
    end = {"END": f"K[{{0}}] == {END!r}"}
    if language == "python":
        ident = "i" + "".join(P.KINDS[w] for w in P.SOFT)
        classes = {"ID": ident, "STR": "s", "BYTES": "b", "NUM": "n", "AUG": "A", "COMPARE": "C", "BINARY": "OP*+-|@/", "NEWLINE": P.NEWLINE, "INDENT": P.INDENT, "DEDENT": P.DEDENT, "BEGIN": P.BEGIN, "MATCH": "M", "CASE": "K", "TRAILER": ".(["}
        return Grammar(P.GRAMMAR, P.OPS | P.KINDS, classes, end)
    if language == "go":
        return Grammar(_GO, X.GO_TABLE | X.GO_KINDS, {"ID": "i", "STR": "s", "NUM": "n", "ASSIGN": "A", "BIN": "B"}, end)
    if language == "java":
        ident = "i" + "".join(X.JAVA_KINDS[w] for w in X.JAVA_CONTEXT)
        classes = {"ID": ident, "STR": "s", "NUM": "n", "ASSIGN": "A", "BIN": "BG+-*|&<", "MODWORD": "".join(X.JAVA_KINDS[w] for w in _JAVA_MODS), "PRIMITIVE": "".join(X.JAVA_KINDS[w] for w in _JAVA_PRIMITIVES)}
        return Grammar(_JAVA, X.JAVA_TABLE | X.JAVA_KINDS | {">=": "G"}, classes, end | {"LAMBDA": "K[{0}] == '(' and M[{0}] >= 0 and K[M[{0}] + 1] == 'F'"})
    return Grammar(_JSON, {c: c for c in "[]{},:"}, {"STR": "s", "NUM": "n", "WORD": "w"}, end)


#: Suffix -> language that it stands for.
SYNTAX_OF = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".go": "go", ".java": "java", ".json": "json"}
_CONFLICT = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?: |\r?$)")


@dataclass
class Verdict:
    """Whether a text parses; if not, the furthest position reached (characters) and the likely cause."""

    valid: bool
    position: int = -1
    cause: str | None = None


def _cause(text: str, at: int, unclosed: bool) -> str:
    line = text.rfind("\n", 0, max(at, 0)) + 1
    if any(abs(m.start() - line) <= 400 for m in _CONFLICT.finditer(text)):
        return "conflict"
    head = text.lstrip()[:200]
    if re.match(r"<!DOCTYPE|<html|--- \S+\n\+\+\+ |#!/|\{|\[\w+\]\n|package |import .* from |#+ |[\w.-]+: ", head) and at < 400:
        return "other_language"
    if unclosed or not text[at:].strip():
        return "truncated"
    return "syntax"


def tokens(text: str, language: str, jsx: bool = True) -> L.Tokens:
    """Tokens of a text in one of the languages with a grammar here."""
    if language in ("javascript", "typescript"):
        return L.lex_js(text, jsx, holes=True)
    return {"go": X.lex_go, "java": X.lex_java, "json": X.lex_json}[language](text)


_TYPE_OF = L.JS_KINDS["type"] + "i="


def _hole_error(text: str, language: str, holes: list[L.Hole]) -> int:
    """Furthest position reached in the first piece of code within templates and JSX that is wrong; -1 if none is."""
    for h in holes:
        t = h.toks
        if h.end < 0:
            return t.error if t.error >= 0 else len(text)
        kinds, breaks, spans = t.kinds[:-1], t.breaks[:-1], t.spans
        if h.kind in "sc" and kinds[:1] == "E":
            kinds, breaks, spans = kinds[1:], breaks[1:], spans[1:]
            if not kinds:
                return h.end
        elif h.kind == "s":
            return h.start
        if not kinds:
            if h.kind == "c":
                continue
            return h.end
        wrapped = f"({kinds}){END}"
        partner, misfit = partners(wrapped)
        far = misfit if misfit >= 0 else grammar(language).parse(wrapped, f"0{breaks}01", partner)
        if far >= 0 and misfit < 0 and h.kind == "t" and language == "typescript":  # a template may be a type
            as_type = f"{_TYPE_OF}{kinds};{END}"
            if grammar(language).parse(as_type, f"000{breaks}01", partners(as_type)[0]) < 0:
                far = -1
        if far >= 0:
            return spans[far - 1][0] if 0 < far <= len(spans) else h.end if far else h.start
        at = _hole_error(text, language, t.holes)
        if at >= 0:
            return at
    return -1


def check_tokens(text: str, language: str, toks: L.Tokens) -> Verdict:
    """Whether a token sequence is a sentence of its language's grammar."""
    n = len(toks.spans)
    if language in ("javascript", "typescript", "go", "java") and not n and toks.error < 0:
        return Verdict(language in ("javascript", "typescript") or not text.strip() or language == "java")
    partner, misfit = partners(toks.kinds)
    toks.mate = partner
    if toks.error < 0 and misfit < 0:
        far = grammar(language).parse(toks.kinds, toks.breaks, partner)
        if far < 0:
            at = _hole_error(text, language, toks.holes)
            return Verdict(True) if at < 0 else Verdict(False, at, _cause(text, at, at >= len(text)))
        at = toks.spans[far][0] if far < n else len(text)
        return Verdict(False, at, _cause(text, at, far >= n))
    ends = [x for x in (toks.error, len(text) if misfit >= n else toks.spans[misfit][0] if misfit >= 0 else -1) if x >= 0]
    if toks.error < 0:  # a rule may fail before the bracket that does not fit
        far = grammar(language).parse(toks.kinds, toks.breaks, partner)
        if 0 <= far < n:
            ends.append(toks.spans[far][0])
    at = min(ends)
    return Verdict(False, at, _cause(text, at, misfit >= n))


def _check_python(text: str) -> Verdict:
    """A lexer with logical lines, the grammar of whole files, and of the expressions within formatted strings."""
    skipped = text.startswith("﻿")
    body = text[1:] if skipped else text
    allow_nesting(len(body))
    toks = P.lex_python(body)
    g = grammar("python")
    at = toks.error
    far = g.parse(toks.kinds, toks.breaks, toks.mate) if at < 0 else -1
    if far >= 0:
        at = toks.spans[far][0] if far < len(toks.spans) else len(body)
    holes = list(toks.holes) if at < 0 else []
    while holes and at < 0:
        h = holes.pop(0)
        holes += h.toks.holes
        line = f"{P.BEGIN}({h.toks.kinds[:-1]}){P.NEWLINE}{END}"
        if g.parse(line, "0" * len(line), P.mates(line)) >= 0:
            at = h.start
    if at < 0:
        return Verdict(True)
    at = min(at + skipped, len(text))
    return Verdict(False, at, _cause(text, at, toks.error == len(body)))


def check(text: str, language: str, jsx: bool = True) -> Verdict:
    """Whether ``text`` is syntactically valid in ``language``.

    Empty program texts are valid, an empty JSON text is not. Only syntax counts.
    """
    if language == "python":
        return _check_python(text)
    allow_nesting(len(text))
    return check_tokens(text, language, tokens(text, language, jsx))


def syntax_of(path: str | None) -> str | None:
    """The language that a path's suffix stands for, if it is one of those checked."""
    name = (path or "").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return SYNTAX_OF.get(name[dot:].lower()) if dot > 0 else None
