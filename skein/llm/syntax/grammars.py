"""Grammars of statements, members and expressions. Brace groups are single tokens whose content is parsed on its own:
{B} block, {C} class body, {E} enum body, {I} initializer, {O} object or composite literal, {S} switch body, {T} type
body, {X} specifiers. Operator precedence plays no part in validity, so expressions are flat operator chains."""

from __future__ import annotations

from skein.llm.syntax.chart import Grammar

JAVA = Grammar("""
Id = ID | var | record | sealed | permits | non | yield | when | module | open
Name = Id ( '.' Id )*
Prim = int | long | double | float | boolean | char | byte | short
Anno = '@' Name ( '(' AnnoArgs? ')' )?
AnnoArgs = AnnoArg ( ',' AnnoArg )*
AnnoArg = Id '=' AnnoVal | AnnoVal
AnnoVal = E | {I} | Anno
Args = '<' ( TypeArg ( ',' TypeArg )* )? '>'
TypeArg = Anno* '?' ( ( extends | super ) Type )? | Type
ClassType = Id Args? ( '.' Anno* Id Args? )*
Dims = ( '[' ']' )*
Type = Anno* ( Prim | ClassType ) Dims
TypeParams = '<' TypeParam ( ',' TypeParam )* '>'
TypeParam = Anno* Id ( extends Type ( '&' Type )* )?
Mod = Anno | public | private | protected | static | final | abstract | native | synchronized | transient | volatile | strictfp | default | sealed | non '-' sealed
Types = Type ( ',' Type )*
Param = ( Anno | final )* Type ( '...' )? ( Id Dims | this | Id '.' this )
Params = '(' ( Param ( ',' Param )* )? ')'
TypeDecl = Mod* ( class Id TypeParams? ( extends Type )? ( implements Types )? ( permits Types )? {C} | interface Id TypeParams? ( extends Types )? ( permits Types )? {C} | enum Id ( implements Types )? {E} | '@' interface Id {C} | record Id TypeParams? Params ( implements Types )? {C} )
Unit = Anno* package Name ';' | import static? Name ( '.' '*' )? ';' | TypeDecl | Mod* module Name {B} | ';'
Init = E | {I}
VarDecl = Id Dims ( '=' Init )?
VarDecls = VarDecl ( ',' VarDecl )*
Throws = throws Types
Member = TypeDecl | Mod* Type VarDecls ';' | Mod* TypeParams? ( Type | void ) Id Params Dims Throws? ( {B} | ';' | default AnnoVal ';' ) | Mod* TypeParams? Id Params Throws? {B} | Id {B} | public Id {B} | static? {B} | ';'
EnumItem = Anno* Id ( '(' ExprList? ')' )? {C}?
EnumItems = ( EnumItem ( ',' EnumItem )* ','? )? ';'?
ExprList = E ( ',' E )*
E = U ( Bin U | instanceof ( final? Type Id? | Pattern ) )* ( Asg E )? | U ( Bin U | instanceof Type Id? )* '?' E ':' E | Lambda
Bin = '+' | '-' | '*' | '/' | '%' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&' | '|' | '^' | '<' '<' | '>' '>' | '>' '>' '>'
Asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
U = ( '+' | '-' | '!' | '~' | '++' | '--' ) U | '(' Type ( '&' Type )* ')' ( U | Lambda ) | P ( '++' | '--' )?
Lambda = ( Id | '(' ( LambdaParam ( ',' LambdaParam )* )? ')' ) '->' ( E | {B} )
LambdaParam = Param | Id
P = Lit | Id | this | super | '(' E ')' | New | P '.' Args? Id | P '.' New | P '.' ( this | class | super ) | P '[' E ']' | P '(' ExprList? ')' | ( P | Type ) '::' Args? ( Id | new ) | Prim Dims '.' class | void '.' class | ClassType '[' ']' Dims '.' class | switch '(' E ')' {S}
Lit = NUM | STR | CHAR | true | false | null
New = new Anno* ClassType '(' ExprList? ')' {C}? | new Anno* ( Prim | ClassType ) ( '[' E ']' )+ Dims | new Anno* ( Prim | ClassType ) '[' ']' Dims {I}
Pattern = final? Type Id | Type '(' ( Pattern ( ',' Pattern )* )? ')' Id?
Local = ( Anno | final )* Type VarDecls
Stmt = {B} | Local ';' | TypeDecl | E ';' | ';' | if '(' E ')' Stmt ( else Stmt )? | while '(' E ')' Stmt | do Stmt while '(' E ')' ';' | For | return E? ';' | throw E ';' | break Id? ';' | continue Id? ';' | Id ':' Stmt | try ( '(' Resource ( ';' Resource )* ';'? ')' )? {B} Catch* ( finally {B} )? | switch '(' E ')' {S} | synchronized '(' E ')' {B} | assert E ( ':' E )? ';' | yield E ';'
Resource = Local | E
Catch = catch '(' ( Anno | final )* Type ( '|' Type )* Id ')' {B}
For = for '(' ( Local | ExprList )? ';' E? ';' ExprList? ')' Stmt | for '(' ( Anno | final )* Type Id ':' E ')' Stmt
Case = case CaseItem ( ',' CaseItem )* ( when E )? ( ':' | '->' ( E ';' | {B} | throw E ';' ) ) | default ( ':' | '->' ( E ';' | {B} | throw E ';' ) )
CaseItem = E | Pattern | default
InSwitch = Case* Stmt | Case+
Inits = ( Init ( ',' Init )* )? ','?
""")

GO = Grammar("""
Id = ID
Type = TypeName | '*' Type | '[' ']' Type | '[' E ']' Type | '[' '...' ']' Type | map '[' Type ']' Type | chan Type | chan '<-' Type | '<-' chan Type | func Sig | struct {T} | interface {T} | '(' Type ')'
TypeName = Id ( '.' Id )? ( '[' Type ( ',' Type )* ']' )?
Param = Id Type | Id '...' Type | Type | '...' Type
Params = '(' ( Param ( ',' Param )* ','? )? ')'
Sig = Params ( Params | Type )?
TypeParams = '[' TypeParam ( ',' TypeParam )* ','? ']'
TypeParam = Id ( ',' Id )* Constraint
Constraint = '~'? Type ( '|' '~'? Type )*
Package = package Id ';'
Unit = import ImportSpec ';' | import '(' ( ImportSpec ';' )* ImportSpec? ')' ';' | Decl ';' | func Id TypeParams? Sig {B}? ';' | func '(' Receiver ')' Id Sig {B}? ';' | ';'
Receiver = Id? '*'? Id ( '[' Id ( ',' Id )* ']' )? ','?
ImportSpec = ( Id | '.' )? STR
Decl = const ConstSpec | const '(' ( ConstSpec ';' )* ConstSpec? ')' | var VarSpec | var '(' ( VarSpec ';' )* VarSpec? ')' | type TypeSpec | type '(' ( TypeSpec ';' )* TypeSpec? ')'
ConstSpec = Ids Type? ( '=' Es )?
VarSpec = Ids Type ( '=' Es )? | Ids '=' Es
TypeSpec = Id TypeParams? '='? Type
Ids = Id ( ',' Id )*
Es = E ( ',' E )*
E = U ( Bin U )*
Bin = '+' | '-' | '*' | '/' | '%' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&' | '|' | '^' | '<<' | '>>' | '&^'
U = ( '+' | '-' | '!' | '^' | '*' | '&' | '<-' ) U | P
P = NUM | STR | CHAR | Id | '(' E ')' | '(' Type ')' | func Sig {B} | LitType {O} | P '.' Id | P '.' '(' ( Type | type ) ')' | P '[' E ']' | P '[' Type ( ',' Type )* ']' | P '[' E? ':' E? ( ':' E )? ']' | P '(' ( CallArg ( ',' CallArg )* ( '...' )? ','? )? ')' | ConvType '(' E ','? ')'
ConvType = '[' ']' Type | map '[' Type ']' Type | chan Type | func Sig | interface {T}
LitType = TypeName | '[' ']' Type | '[' E ']' Type | '[' '...' ']' Type | map '[' Type ']' Type | struct {T}
CallArg = E | Type
Simple = Es ( '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ) Es | E '++' | E '--' | E '<-' E | E
Stmt = Simple? ';' | Decl ';' | return Es? ';' | If ';' | For ';' | Switch ';' | select {S} ';' | go E ';' | defer E ';' | break Id? ';' | continue Id? ';' | goto Id ';' | fallthrough ';' | {B} ';' | Id ':' Stmt | Id ':' ';'
If = if ( Simple? ';' )? E {B} ( else ( If | {B} ) )?
For = for {B} | for E {B} | for Simple? ';' E? ';' Simple? {B} | for ( Es ( '=' | ':=' ) )? range E {B}
Switch = switch ( Simple? ';' )? ( E | Id ':=' E )? {S}
Case = case ( CaseItem ( ',' CaseItem )* ) ':' | case Simple ':' | default ':'
CaseItem = E | Type
InSwitch = Case* Stmt | Case+
Field = Ids Type STR? ';' | '*'? TypeName STR? ';' | ';'
Method = Id Sig ';' | Constraint ';' | ';'
InType = Field | Method
Element = Es | E ':' E | {O} | E ':' {O} | {O} ':' E | {O} ':' {O}
Elements = ( ElementOne ( ',' ElementOne )* ','? )?
ElementOne = E | E ':' E | {O} | E ':' {O} | {O} ':' E | {O} ':' {O}
""")

_JS_COMMON = """
Id = ID | async | await | of | get | set | static | let | yield | from | as | type | interface | implements | private | protected | public | readonly | abstract | declare | namespace | module | is | keyof | infer | asserts | satisfies | override | accessor | unique | global | target | any | never | unknown | string | number | boolean | symbol | object | bigint
Word = Id | break | case | catch | class | const | continue | debugger | default | delete | do | else | enum | export | extends | false | finally | for | function | if | import | in | instanceof | new | null | return | super | switch | this | throw | true | try | typeof | var | void | while | with
Key = Word | STR | NUM | '[' E ']'
Es = E ( ',' E )*
E = Arrow | async Arrow | yield '*'? E? | Cond | Left Asg E
Left = Cond
Cond = Chain ( '?' E ':' E )?
Chain = U ( Bin U )*
Bin = '+' | '-' | '*' | '/' | '%' | '**' | '&&' | '||' | '??' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | in | instanceof
Asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '>' '>=' | '>' '>' '>='
U = ( '+' | '-' | '!' | '~' | typeof | void | delete | await | '++' | '--' ) U | Post
Post = P ( '++' | '--' )?
Arg = E | '...' E
Args = '(' ( Arg ( ',' Arg )* ','? )? ')'
P = NUM | STR | TPL | REGEX | true | false | null | this | super | Id | '(' Es ')' | '[' Elems ']' | {O} | Func | ClassExpr | P ( '.' | '?.' ) Word | P '?.'? '[' Es ']' | P '?.'? Args | P TPL | new P | new '.' target | import Args | import '.' Word
Elems = ( Arg | ',' )* 
Func = async? function '*'? Id? Rest
Bind = Id | {O} | '[' ( BindElem | ',' )* ']'
BindElem = '...'? Bind ( '=' E )?
ForHead = ( ( var | let | const ) Bind ( '=' E )? ( ',' Bind ( '=' E )? )* | Es )? ';' Es? ';' Es? | ( ( var | let | const ) Bind | Left ) ( of | in ) Es
Stmt = {B} | Decl | Es ';' | ';' | if '(' Es ')' Stmt ( else Stmt )? | while '(' Es ')' Stmt | do Stmt while '(' Es ')' ';'? | for await? '(' ForHead ')' Stmt | return Es? ';' | throw Es ';' | break Id? ';' | continue Id? ';' | Id ':' Stmt | try {B} ( catch ( '(' CatchBind ')' )? {B} )? ( finally {B} )? | switch '(' Es ')' {S} | debugger ';'
VarDecl = ( var | let | const ) Var ( ',' Var )* ';'
Case = case Es ':' | default ':'
InSwitch = Case* Stmt | Case+
Specs = ( Spec ( ',' Spec )* ','? )?
Unit = Stmt | import ImportClause from STR ';' | import STR ';' | export {X} ( from STR )? ';' | export '*' ( as Word )? from STR ';' | export default ( E ';' | Func | Decl | ClassExpr ) | Deco* export Deco* Decl
Deco = '@' DecoExpr
DecoExpr = Id | DecoExpr '.' Word | DecoExpr Args | '(' E ')'
"""

JAVASCRIPT = Grammar(_JS_COMMON + """
Arrow = ( Id | Params ) '=>' ( E | {B} )
Params = '(' ( Param ( ',' Param )* ','? )? ')'
Param = '...'? Bind ( '=' E )?
Rest = Params {B}
CatchBind = Bind
Var = Bind ( '=' E )?
Decl = VarDecl | async? function '*'? Id Rest | Deco* class Id ( extends P )? {C}
ClassExpr = Deco* class Id? ( extends P )? {C}
Member = Deco* static? ( async | get | set )? '*'? Key Rest ';'? | Deco* static? Key ( '=' E )? ';' | static {B} | ';'
Prop = ( async | get | set )? '*'? Key Rest | Key ':' PropVal | Id ( '=' E )? | '...' E
PropVal = E
Props = ( Prop ( ',' Prop )* ','? )?
Spec = Word ( as Word )? | STR as Word
ImportClause = Id | {X} | '*' as Id | Id ',' ( {X} | '*' as Id )
""")

TYPESCRIPT = Grammar(_JS_COMMON.replace("| P '?.'? Args |", "| P '?.'? TypeArgs? Args | P '!' |").replace("Chain = U ( Bin U )*", "Chain = U ( Bin U | ( as | satisfies ) ( Type | const ) )*").replace("U = (", "U = '<' Type '>' U | (") + """
Arrow = ( Id | TypeParams? Params ( ':' Ret )? ) '=>' ( E | {B} )
Params = '(' ( Param ( ',' Param )* ','? )? ')'
Param = Deco* ( public | private | protected | readonly | override )* '...'? ( Bind | this ) '?'? ( ':' Type )? ( '=' E )?
Ret = Type | asserts? ( Id | this ) is Type | asserts ( Id | this )
Rest = TypeParams? Params ( ':' Ret )? ( {B} | ';' )
CatchBind = Bind ( ':' Type )?
Var = Bind '!'? ( ':' Type )? ( '=' E )?
Heritage = ( extends P TypeArgs? ( ',' P TypeArgs? )* )? ( implements Type ( ',' Type )* )?
Decl = declare? ( VarDecl | async? function '*'? Id Rest | Deco* abstract? class Id TypeParams? Heritage {C} | interface Id TypeParams? ( extends Type ( ',' Type )* )? {T} | type Id TypeParams? '=' Type ';' | const? enum Id {N} | ( namespace | module ) ( Id ( '.' Id )* | STR ) ( {B} | ';' ) | global {B} )
ClassExpr = Deco* abstract? class Id? TypeParams? Heritage {C}
MemberMod = public | private | protected | static | abstract | readonly | override | declare | accessor
Member = Deco* MemberMod* ( async | get | set )? '*'? Key '?'? Rest ';'? | Deco* MemberMod* Key ( '?' | '!' )? ( ':' Type )? ( '=' E )? ';' | MemberMod* IndexSig ';' | static {B} | ';'
IndexSig = '[' Id ':' Type ']' ':' Type
Prop = ( async | get | set )? '*'? Key TypeParams? Params ( ':' Ret )? {B} | Key ':' E | Id ( '=' E )? | '...' E
Props = ( Prop ( ',' Prop )* ','? )?
Spec = type? Word ( as Word )? | STR as Word
ImportClause = type? ( Id | {X} | '*' as Id | Id ',' ( {X} | '*' as Id ) )
TypeParams = '<' TypeParam ( ',' TypeParam )* ','? '>'
TypeParam = ( const | in )? Id ( extends Type )? ( '=' Type )?
TypeArgs = '<' Type ( ',' Type )* '>'
Type = '|'? '&'? TypeOne ( ( '|' | '&' ) TypeOne )* ( extends Type '?' Type ':' Type )? | abstract? new? TypeParams? Params '=>' Ret
TypeOne = ( keyof | unique | readonly | infer ) TypeOne | TypePrimary
TypePrimary = Id ( '.' Word )* TypeArgs? | void | null | this | true | false | STR | '-'? NUM | TPL | {T} | {O} | '(' Type ')' | '[' ( TupleItem ( ',' TupleItem )* ','? )? ']' | TypePrimary '[' ']' | TypePrimary '[' Type ']' | typeof Id ( '.' Word )* TypeArgs? | import '(' Type ')' ( '.' Word )* TypeArgs?
TupleItem = '...'? ( Word '?'? ':' )? Type '?'?
InType = TypeMember ( ( ',' | ';' )* TypeMember )* ( ',' | ';' )* | ( ',' | ';' )*
TypeMember = readonly? Key '?'? ( ':' Type )? | ( get | set )? Key '?'? TypeParams? Params ( ':' Ret )? | new? TypeParams? Params ( ':' Ret )? | readonly? IndexSig | ( '+' | '-' )? readonly? '[' Id in Type ( as Type )? ']' ( ( '+' | '-' )? '?' )? ':' Type
EnumItems = ( EnumItem ( ',' EnumItem )* ','? )?
EnumItem = ( Word | STR ) ( '=' E )?
""")

PYTHON = Grammar("""
Id = ID | match | case | type
Simple = Stars ( Aug Right | ( '=' Right )+ )? | Target ':' E ( '=' Right )? | return Stars? | pass | break | continue | raise ( E ( from E )? )? | del Es | assert E ( ',' E )? | global Ids | nonlocal Ids | import Dotted ( as Id )? ( ',' Dotted ( as Id )? )* | from ( '.' | '...' )* Dotted import Names | from ( '.' | '...' )+ import Names | Yield | type Id TypeParams? '=' E
Target = P | '(' P ')'
Right = Stars | Yield
Yield = yield ( from E | Stars )?
Aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Dotted = Id ( '.' Id )*
Ids = Id ( ',' Id )*
Names = '*' | Name ( ',' Name )* | '(' Name ( ',' Name )* ','? ')'
Name = Id ( as Id )?
Es = E ( ',' E )* ','?
Star = '*' Or | N
Stars = Star ( ',' Star )* ','?
N = E | Id ':=' E
E = Or ( if Or else E )? | lambda LambdaParams? ':' E
Or = Not ( ( and | or | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | in | not in | is | is not ) Not )*
Not = ( not | '+' | '-' | '~' | await ) Not | P
P = Id | NUM | STR+ | '...' | None | True | False | '(' ( Stars | Yield | Gen )? ')' | '[' ( Stars | Gen )? ']' | '{' ( Stars | Gen | Dict )? '}' | P '.' Id | P '(' CallArgs? ')' | P '[' Slices ']'
Gen = N Comp+
Comp = async? for TargetList in Or ( if OrIf )*
OrIf = Or | Id ':=' E | lambda LambdaParams? ':' E
TargetList = TargetOne ( ',' TargetOne )* ','?
TargetOne = '*'? ( P )
Dict = DictItem ( ',' DictItem )* ','? | E ':' E Comp+
DictItem = E ':' E | '**' Or
CallArgs = CallArg ( ',' CallArg )* ','?
CallArg = N | Gen | Id '=' E | '*' E | '**' E
Slices = Slice ( ',' Slice )* ','?
Slice = N | '*' E | E? ':' E? ( ':' E? )?
LambdaParams = LambdaParam ( ',' LambdaParam )* ','?
LambdaParam = Id ( '=' E )? | '*' Id? | '**' Id | '/'
Params = Param ( ',' Param )* ','?
Param = Id ( ':' E )? ( '=' E )? | '*' | '*' Id ( ':' Star )? | '**' Id ( ':' E )? | '/'
TypeParams = '[' TypeParam ( ',' TypeParam )* ','? ']'
TypeParam = ( '*' | '**' )? Id ( ':' E )? ( '=' E )?
Head = async? def Id TypeParams? '(' Params? ')' ( '->' E )? | class Id TypeParams? ( '(' CallArgs? ')' )? | if N | elif N | else | while N | async? for TargetStars in Stars | try | except '*'? ( Stars ( as Id )? )? | finally | async? with WithItems | match Stars | case Patterns ( if N )?
TargetStars = Star ( ',' Star )* ','?
WithItems = WithItem ( ',' WithItem )* | '(' WithItem ( ',' WithItem )* ','? ')'
WithItem = E ( as Target )?
Patterns = Pattern ( ',' Pattern )* ','?
Pattern = '*'? PatOne ( '|' PatOne )* ( as Id )?
PatOne = '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | None | True | False | Dotted | Dotted '(' ( PatArg ( ',' PatArg )* ','? )? ')' | '(' Patterns? ')' | '[' Patterns? ']' | '{' ( PatKey ( ',' PatKey )* ','? )? '}'
PatArg = ( Id '=' )? Pattern
PatKey = ( '-'? NUM | STR+ | None | True | False | Dotted ) ':' Pattern | '**' Id
Line = Simple | Head ':' | Head ':' Simple | '@' N
""")
