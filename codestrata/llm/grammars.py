"""Grammars of the languages whose files are checked, over the tokens of lexers.py.

DIALECTS names each language's dialects, oldest first; `@d` in a rule stands before what exists from dialect d on. All
dialects of a language are parsed together, a file being valid if any of them derives it. JSON and YAML have one each.
"""

DIALECTS = {
    "php": ("7.4", "8.0", "8.1", "8.2", "8.3", "8.4"),
    "python": ("3.7", "3.8", "3.9", "3.10", "3.11", "3.12", "3.13"),
    "json": ("rfc8259",),
    "yaml": ("1.1",),
    "xml": ("standalone", "external"),
}

JSON = """
value : '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']' | STRING | NUMBER | WORD ;
pair : STRING ':' value ;
"""

XML = """
document : DECL? misc* (DOCTYPE misc*)? undeclared? element misc* ;
undeclared : @external UNDECLARED ;
misc : COMMENT | PI | SPACE ;
element : EMPTY | OPEN content* CLOSE ;
content : element | TEXT | SPACE | CDATA | COMMENT | PI | undeclared ;
"""

YAML = """
stream : implicit? explicit* ;
implicit : block_node DOC_END* ;
explicit : DOC_END* DIRECTIVE* DOC_START block_node? DOC_END* ;
block_node : ALIAS | properties block_content? | block_content ;
loose_node : ALIAS | properties (block_content | indentless)? | block_content | indentless ;
flow_node : ALIAS | properties flow_content? | flow_content ;
properties : TAG ANCHOR? | ANCHOR TAG? ;
block_content : block_seq | block_map | flow_content ;
flow_content : flow_seq | flow_map | SCALAR ;
block_seq : SEQ_START (ENTRY block_node?)* BLOCK_END ;
indentless : (ENTRY block_node?)+ ;
block_map : MAP_START (KEY loose_node? (VALUE loose_node?)?)* BLOCK_END ;
flow_seq : '[' (flow_item (',' flow_item)* ','?)? ']' ;
flow_map : '{' (flow_item (',' flow_item)* ','?)? '}' ;
flow_item : flow_node | KEY flow_node? (VALUE flow_node?)? ;
"""

PHP = """
file : top* ;
top : statement | 'namespace' (name (';' | '{' top* '}') | '{' top* '}') | use_import | 'const' constant (',' constant)* ';' | '__halt_compiler' ';' ;
constant : NAME '=' expr ;
use_import : 'use' ('function' | 'const')? ( use_one (',' use_one)* | name '\\' '{' use_part (',' use_part)* ','? '}' ) ';' ;
use_one : name ('as' NAME)? ;
use_part : ('function' | 'const')? name ('as' NAME)? ;
name : NAME | QNAME ;
names : name (',' name)* ;
block : '{' statement* '}' ;
parens : '(' expr ')' ;
exprs : expr (',' expr)* ;

statement : block | ';' | HTML | OPEN_ECHO exprs ';' | 'echo' exprs ';' | expr ';' | NAME ':'
  | 'if' parens ( statement ('elseif' parens statement)* ('else' statement)?
                | ':' statement* ('elseif' parens ':' statement*)* ('else' ':' statement*)? 'endif' ';' )
  | 'while' parens ( statement | ':' statement* 'endwhile' ';' )
  | 'do' statement 'while' parens ';'
  | 'for' '(' exprs? ';' exprs? ';' exprs? ')' ( statement | ':' statement* 'endfor' ';' )
  | 'foreach' '(' expr 'as' target ('=>' target)? ')' ( statement | ':' statement* 'endforeach' ';' )
  | 'switch' parens ( '{' ';'? case_item* '}' | ':' ';'? HTML? case_item* 'endswitch' ';' )
  | 'throw' expr ';' | 'break' expr? ';' | 'continue' expr? ';' | 'return' expr? ';'
  | 'global' simple_variable (',' simple_variable)* ';'
  | 'static' static_variable (',' static_variable)* ';'
  | 'unset' '(' expr (',' expr)* ','? ')' ';'
  | 'try' block ( catch+ ('finally' block)? | 'finally' block )
  | 'goto' NAME ';'
  | 'declare' '(' NAME '=' expr (',' NAME '=' expr)* ')' ( statement | ':' statement* 'enddeclare' ';' )
  | attributes? ( function_declaration | class_declaration ) ;
catch : 'catch' '(' name ('|' name)* (VAR | @8.0) ')' block ;
case_item : ('case' expr | 'default') (':' | ';') statement* ;
static_variable : VAR ('=' expr)? ;
simple_variable : VAR | '$' simple_variable | '$' '{' expr '}' ;
target : '&' variable | variable | array | 'list' '(' items ')' ;

function_declaration : 'function' '&'? (NAME | 'readonly') '(' parameters ')' (':' type)? block ;
class_declaration : ('abstract' | 'final' | @8.2 'readonly')* 'class' NAME ('extends' name)? ('implements' names)? members
  | 'interface' NAME ('extends' names)? members | 'trait' NAME members
  | @8.1 'enum' NAME (':' type)? ('implements' names)? members ;
attributes : @8.0 ('#[' attribute (',' attribute)* ','? ']')+ ;
attribute : name arguments? ;
parameters : (parameter (',' parameter)* (@8.0 ',')?)? ;
parameter : attributes? (@8.0 modifier+)? type? '&'? '...'? VAR ('=' expr)? hooks? ;
type : '?' simple_type | type_part (@8.0 '|' type_part)* ;
type_part : simple_type (@8.1 '&' simple_type)* | @8.2 '(' simple_type ('&' simple_type)+ ')' ;
simple_type : NAME | QNAME | 'array' | 'callable' | @8.0 'static' ;
modifier : ('public' | 'protected' | 'private') (@8.4 '(' NAME ')')? | 'static' | 'abstract' | 'final' | @8.1 'readonly' | 'var' ;

members : '{' member* '}' ;
member : attributes? ( modifier+ (class_constant | method | property) | class_constant | method )
  | 'use' names (';' | '{' adaptation* '}') | attributes? @8.1 'case' member_name ('=' expr)? ';' ;
class_constant : 'const' (@8.3 type)? member_name '=' expr (',' member_name '=' expr)* ';' ;
method : 'function' '&'? member_name '(' parameters ')' (':' type)? (';' | block) ;
property : type? VAR ('=' expr)? ( (',' VAR ('=' expr)?)* ';' | hooks ) ;
hooks : @8.4 '{' hook* '}' ;
hook : attributes? modifier* '&'? NAME ('(' parameters ')')? (';' | block | '=>' expr ';') ;
adaptation : (name '::')? member_name ( 'insteadof' names | 'as' ( ('public' | 'protected' | 'private') member_name? | member_name ) ) ';' ;
member_name : NAME | MAGIC | 'enum' | 'abstract' | 'and' | 'array' | 'as' | 'break' | 'callable' | 'case' | 'catch' | 'class' | 'clone'
  | 'const' | 'continue' | 'declare' | 'default' | 'do' | 'echo' | 'else' | 'elseif' | 'empty' | 'enddeclare' | 'endfor' | 'endforeach'
  | 'endif' | 'endswitch' | 'endwhile' | 'eval' | 'exit' | 'extends' | 'final' | 'finally' | 'fn' | 'for' | 'foreach' | 'function' | 'global'
  | 'goto' | 'if' | 'implements' | 'include' | 'include_once' | 'instanceof' | 'insteadof' | 'interface' | 'isset' | 'list' | 'match'
  | 'namespace' | 'new' | 'or' | 'print' | 'private' | 'protected' | 'public' | 'readonly' | 'require' | 'require_once' | 'return'
  | 'static' | 'switch' | 'throw' | 'trait' | 'try' | 'unset' | 'use' | 'var' | 'while' | 'xor' | 'yield' ;

expr : unary ( operator unary | 'instanceof' class_reference | '?' expr? ':' unary )* ;
operator : '+' | '-' | '*' | '/' | '%' | '.' | '**' | '<<' | '>>' | '<' | '<=' | '>' | '>=' | '==' | '!=' | '<>' | '===' | '!==' | '<=>'
  | '&' | '|' | '^' | '&&' | '||' | '??' | 'and' | 'or' | 'xor' ;
unary : ('+' | '-' | '!' | '~' | '@' | CAST | 'clone' | 'print' | @8.0 'throw' | 'include' | 'include_once' | 'require' | 'require_once' | 'yield from')* operand ;
operand : ('++' | '--') variable
  | base suffix* ending?
  | ( name | 'static' ) ( suffix+ ending? )?
  | ( parens | STR | quoted | new ) ( suffix+ ending? )?
  | array ( suffix+ ending? | '=' unary )?
  | 'list' '(' items ')' '=' unary
  | INT | FLOAT | MAGIC | closure | match
  | 'isset' '(' expr (',' expr)* ','? ')' | 'empty' parens | 'eval' parens | 'exit' arguments?
  | 'yield' ( expr ('=>' expr)? )? ;
base : simple_variable ;
referred : ( base | name | 'static' | parens | STR | quoted | array ) suffix* | new access suffix* ;
variable : ( base | name | 'static' | parens | STR | quoted | array | new ) suffix* ;
suffix : access | arguments ;
access : '[' expr? ']' | ('->' | @8.0 '?->') ( NAME | simple_variable | '{' expr '}' )
  | '::' ( NAME | simple_variable | 'class' | @8.3 '{' expr '}' ) ;
ending : '=' ( '&' referred | unary ) | ('+=' | '-=' | '*=' | '/=' | '.=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '??=') unary | '++' | '--' ;
arguments : '(' (argument (',' argument)* ','?)? ')' ;
argument : '...' (expr | @8.1) | @8.0 member_name ':' expr | expr ;
array : '[' items ']' | 'array' '(' items ')' ;
items : item? (',' item?)* ;
item : expr ('=>' (expr | '&' variable | 'list' '(' items ')'))? | '&' variable | '...' expr | 'list' '(' items ')' ;
new : 'new' ( attributes? (@8.3 'readonly')? 'class' arguments? ('extends' name)? ('implements' names)? members | class_reference arguments? ) ;
class_reference : name | 'static' | parens | base ( '[' expr? ']' | ('->' | '?->') ( NAME | simple_variable | '{' expr '}' ) | '::' simple_variable )*
  | name '::' simple_variable | 'static' '::' simple_variable ;
closure : attributes? 'static'? ( 'function' '&'? '(' parameters ')' ( 'use' '(' ('&'? VAR (',' '&'? VAR)* ','?)? ')' )? (':' type)? block
  | 'fn' '&'? '(' parameters ')' (':' type)? '=>' unary ) ;
match : @8.0 'match' parens '{' (arm (',' arm)* ','?)? '}' ;
arm : ('default' ','? | expr (',' expr)* ','?) '=>' expr ;
quoted : DQ_OPEN ( ENC_VAR | ENC_OPEN expr ENC_CLOSE )* DQ_CLOSE ;
"""

PYTHON = """
file : ( NEWLINE | statement )* ;
statement : simple (';' simple)* ';'? NEWLINE | compound ;
simple : assignment | 'return' star_exprs? | 'raise' (expr ('from' expr)?)? | 'pass' | 'break' | 'continue' | 'del' targets
  | 'assert' expr (',' expr)? | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | import | @3.12 'type' NAME type_params? '=' expr ;
import : 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)*
  | 'from' ( ('.' | '...')* dotted | ('.' | '...')+ ) 'import' ( '*' | imported (',' imported)* | '(' imported (',' imported)* ','? ')' ) ;
dotted : NAME ('.' NAME)* ;
imported : NAME ('as' NAME)? ;
assignment : star_exprs | yield | (targets '=')+ (star_exprs | yield)
  | target augmented (star_exprs | yield) | (target | '(' target ')') ':' expr ('=' (star_exprs | yield))? ;
augmented : '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
targets : star_target (',' star_target)* ','? ;
star_target : '*'? target_part ;
target_part : target | '(' targets? ')' | '[' targets? ']' ;
target : NAME | atom trailer* ( '.' NAME | '[' slices ']' ) ;
yield : 'yield' ( 'from' expr | star_exprs )? ;

compound : 'if' named block ('elif' named block)* ('else' block)?
  | 'while' named block ('else' block)?
  | 'async'? 'for' targets 'in' star_exprs block ('else' block)?
  | 'try' block ( except+ ('else' block)? ('finally' block)? | 'finally' block )
  | 'async'? 'with' ( with_item (',' with_item)* | @3.9 '(' with_item (',' with_item)* ','? ')' ) block
  | ('@' named NEWLINE)* ( 'async'? 'def' NAME type_params? '(' parameters? ')' ('->' expr)? block | 'class' NAME type_params? arguments? block )
  | @3.10 'match' subject ':' NEWLINE INDENT case+ DEDENT ;
block : ':' ( simple (';' simple)* ';'? NEWLINE | NEWLINE INDENT ( statement | NEWLINE )+ DEDENT ) ;
except : 'except' ( (@3.11 '*')? expr ('as' NAME)? )? block ;
with_item : expr ('as' target_part)? ;
type_params : @3.12 '[' type_param (',' type_param)* ','? ']' ;
type_param : ('*' | '**')? NAME (':' expr)? (@3.13 '=' expr)? ;
subject : star_named ','? | star_named (',' star_named)+ ','? ;
case : 'case' patterns ('if' named)? block ;
patterns : open_pattern (',' open_pattern)* ','? ;
open_pattern : '*' NAME | pattern ;
pattern : closed ('|' closed)* ('as' NAME)? ;
closed : '-'? NUMBER (('+' | '-') NUMBER)? | strings | 'None' | 'True' | 'False' | dotted ( '(' (pattern_argument (',' pattern_argument)* ','?)? ')' )?
  | '(' patterns? ')' | '[' patterns? ']' | '{' (pattern_item (',' pattern_item)* ','?)? '}' ;
pattern_argument : pattern | NAME '=' pattern ;
pattern_item : ('-'? NUMBER (('+' | '-') NUMBER)? | strings | dotted | 'None' | 'True' | 'False') ':' pattern | '**' NAME ;

parameters : front (',' stars)? ','? | stars ','? ;
front : bare (',' bare)* (@3.8 ',' '/' (',' bare)*)? (',' given)* | bare (',' bare)* (',' given)+ @3.8 ',' '/' (',' given)* | given (',' given)* (@3.8 ',' '/' (',' given)*)? ;
stars : '*' NAME (':' ( expr | @3.11 '*' binary ))? (',' plain)* (',' keywords)? | '*' (',' plain)+ (',' keywords)? | keywords ;
keywords : '**' bare ;
bare : NAME (':' expr)? ;
given : bare '=' expr ;
plain : bare ('=' expr)? ;
lambda_parameters : l_front (',' l_stars)? ','? | l_stars ','? ;
l_front : NAME (',' NAME)* (@3.8 ',' '/' (',' NAME)*)? (',' l_given)* | NAME (',' NAME)* (',' l_given)+ @3.8 ',' '/' (',' l_given)* | l_given (',' l_given)* (@3.8 ',' '/' (',' l_given)*)? ;
l_stars : '*' NAME (',' l_plain)* (',' '**' NAME)? | '*' (',' l_plain)+ (',' '**' NAME)? | '**' NAME ;
l_given : NAME '=' expr ;
l_plain : NAME ('=' expr)? ;

star_exprs : star_expr (',' star_expr)* ','? ;
star_expr : expr | '*' binary ;
star_named : '*' binary | named ;
named : NAME @3.8 ':=' expr | expr ;
expr : logical ('if' logical 'else' expr)? | 'lambda' lambda_parameters? ':' expr ;
logical : 'not'* comparison (('and' | 'or') 'not'* comparison)* ;
comparison : binary (('<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?) binary)* ;
binary : factor (('|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**') factor)* ;
factor : ('+' | '-' | '~')* 'await'? atom trailer* ;
trailer : '.' NAME | arguments | '[' slices ']' ;
slices : slice (',' slice)* ','? ;
slice : @3.11 '*' binary | named | expr? ':' expr? (':' expr?)? ;
arguments : '(' ( named comprehension | positional (',' positional)* (',' named_arguments)? ','? | named_arguments ','? )? ')' ;
positional : named | '*' expr ;
named_arguments : (NAME '=' expr | '*' expr) (',' (NAME '=' expr | '*' expr))* (',' (NAME '=' expr | '**' expr))* | '**' expr (',' (NAME '=' expr | '**' expr))* ;
comprehension : ('async'? 'for' targets 'in' logical ('if' condition)*)+ ;
condition : logical | NAME @3.8 ':=' logical ;
atom : NAME | NUMBER | strings | 'None' | 'True' | 'False' | '...' | '(' ( yield | star_named comprehension | (star_named (',' star_named)* ','?)? ) ')'
  | '[' ( star_named comprehension | (star_named (',' star_named)* ','?)? ) ']'
  | '{' ( (dict_item (',' dict_item)* ','?)? | expr ':' expr comprehension | star_named comprehension | star_named (',' star_named)* ','? ) '}' ;
dict_item : expr ':' expr | '**' binary ;
strings : (STRING | fstring)+ | BYTES+ ;
fstring : FS_START ( FS_MIDDLE | '{' (star_exprs | yield) '='? ('!' NAME)? (':' format)? '}' )* FS_END ;
format : ( FS_MIDDLE | '{' (star_exprs | yield) '='? ('!' NAME)? (':' format)? '}' )* ;
"""
