"""Fact shapes by language: how lines of each language are read.

All patterns keep to the subset that Java's regex engine and RE2 read alike (no
look-around, no back-references), so that the same row can drive both engines.
"""

from __future__ import annotations

from dataclasses import dataclass

NAME = r"[A-Za-z_]\w*"
# The repeats give nothing back, so a literal of any length is matched in constant depth.
DOUBLE = r'"(?:[^"\\]|\\.)*+"'
SINGLE = r"'(?:[^'\\]|\\.)*+'"
QUOTED = DOUBLE + "|" + SINGLE


@dataclass(frozen=True)
class Language:
    name: str
    comment: str            # whole-line comment
    assign: str             # group 1 targets, group 2 right-hand side
    token: str              # group 1 identifier
    literal: str            # string literals to blank before reading identifiers
    interpolation: str      # group 1 expression inside a string; '' if none
    source: str             # user-controlled expression
    direct: str             # source that taints the line it stands on
    killer: str             # right-hand side that ends taint of any category
    safe_source: str        # line that looks like a source but is server-derived
    db_source: str          # second-order source
    function: str           # group 1 name, group 2 parameters
    tainted_param: str      # parameter text that is user-controlled
    all_params: bool        # every parameter is user-controlled
    safe_param: str         # parameter text that is never user-controlled
    returns: str            # group 1 returned expression


NEVER = r"[^\s\S]"

# Request objects, conversions and fetch calls of each language.
PYTHON = Language(
    name="python",
    comment=r"^\s*#",
    assign=r"^\s*([A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_]\w*)*)\s*\+?=\s*([^=].*)$",
    token=r"([A-Za-z_]\w*)",
    literal=QUOTED,
    interpolation=r"\{([A-Za-z_][^{}]*)\}",
    source=r"\brequest\.(?:args|form|json|data|values|files|cookies|headers|get_json|get_data|GET|POST|body|COOKIES|META|FILES)\b"
           r"|\b(?:Query|Body|Form|File|Header|Cookie|Path)\(|\b(?:raw_)?input\("
           r"|\bsys\.argv\b|\bos\.environ\b|\bos\.getenv\b|\benviron\.get\b",
    direct=r"\brequest\.(?:args|form|json|data|values|files|cookies|headers|get_json|get_data|GET|POST|body|COOKIES|META|FILES)\b|\b(?:raw_)?input\(|\bsys\.argv\b",
    killer=NEVER,
    safe_source=NEVER,
    db_source=r"\.query\(.*\)\.(?:first|one|all|scalar)\(|\.execute\(.*\)\.fetch|\.objects\.(?:get|filter)\("
              r"|\.fetch(?:one|all|many)\(|\bread_sql",
    function=r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)",
    tainted_param=r"^(?:cmd|command|query|user_input|payload|url|filename|data)\b|=\s*(?:Query|Body|Form|File|Header|Cookie|Path)\(",
    all_params=False,
    safe_param=r"^(?:self|cls)$|:\s*(?:int|float|bool)\b",
    returns=r"^\s*return\s+(.+)$",
)

JAVASCRIPT = Language(
    name="javascript",
    comment=r"^\s*(?://|/\*|\*)",
    assign=r"^\s*(?:(?:const|let|var)\s+)?([\w.$]+|\{[^}]*\}|\[[^\]]*\])\s*\+?=\s*([^=>].*)$",
    token=r"([A-Za-z_$][\w$]*)",
    literal=QUOTED + r"|`[^`]*`",
    interpolation=r"\$\{([^}]*)\}",
    source=r"\b(?:req|request)\.(?:body|query|params|cookies|headers)\b|\bprocess\.argv\b"
           r"|\bdocument\.(?:location|URL|documentURI|referrer|cookie)\b|\bwindow\.(?:location|name)\b"
           r"|\blocation\.(?:href|search|hash|pathname)\b|\bURL(?:SearchParams)?\s*\(|\w\.(?:get|getAll)\s*\("
           r"|\b(?:local|session)Storage\.getItem\s*\(",
    direct=r"\b(?:req|request)\.(?:body|query|params|cookies|headers)\b|\blocation\.(?:href|search|hash)\b|\bprocess\.argv\b",
    killer=r"(?i)(?:escape(?:Html|Shell|Regex)|sanitize\w*|DOMPurify\.sanitize|validator\.\w+|parseInt|parseFloat"
           r"|Number|Boolean|isNaN|isFinite|encodeURI(?:Component)?|xss|clean|purify)\s*\("
           r"|\.(?:test|indexOf|lastIndexOf|includes|startsWith|endsWith|search|every|some|localeCompare)\s*\(",
    safe_source=NEVER,
    db_source=r"\bawait\s+(?:\w+|db\.\w+|db\.collection\([^)]*\))\.(?:findOne|findById|find|findByPk)\s*\(",
    function=r"\bfunction\s+(\w+)\s*\(([^)]*)\)",
    tainted_param=NEVER,
    all_params=False,
    safe_param=NEVER,
    returns=r"^\s*return\s+(.+)$",
)

JAVA = Language(
    name="java",
    comment=r"^\s*(?://|/\*|\*)",
    assign=r"(?:^|[\s(])([\w.]+)\s*\+?=\s*([^=;][^;]*);",
    token=r"([A-Za-z_]\w*)",
    literal=DOUBLE,
    interpolation="",
    source=r"\.get(?:Parameter|ParameterValues|ParameterMap|Header|Headers|HeaderNames|QueryString|RequestURI|RequestURL|PathInfo|Cookies|InputStream|Reader|Part|Parts)\s*\(",
    direct=r"\.get(?:Parameter|Header|QueryString)\s*\(",
    killer=r"(?:Integer|Long|Short|Byte|Float|Double)\s*\.\s*(?:parseInt|parseLong|parseShort|parseByte|parseFloat|parseDouble|valueOf)\s*\("
           r"|Boolean\s*\.\s*(?:parseBoolean|valueOf)\s*\(|UUID\s*\.\s*fromString\s*\("
           r"|Math\s*\.\s*(?:abs|max|min|round|ceil|floor|toIntExact)\s*\(",
    safe_source=NEVER,
    db_source=r"\w\.find\s*\(\s*\w+\.class|\w\.(?:findById|getOne|getReferenceById)\s*\(|Repo(?:sitory)?\.find",
    function=r"(?:public|private|protected)\s+(?:static\s+)?[\w<>,?\[\]]+\s+(\w+)\s*\(([^)]*)\)",
    tainted_param=r"@(?:RequestParam|PathVariable|RequestBody|RequestHeader|CookieValue|MatrixVariable|RequestPart|ModelAttribute)\b"
                  r"|\b(?:HttpServletRequest|ServletRequest|MultipartFile|MultipartHttpServletRequest|WebRequest|NativeWebRequest)\b",
    all_params=False,
    safe_param=r"^(?:int|long|short|byte|float|double|boolean|Integer|Long|UUID)\s"
               r"|^(?:Connection|EntityManager|Session|SessionFactory|DataSource|JdbcTemplate|TransactionManager|Logger|Log)\s",
    returns=r"^\s*return\s+(.+);",
)

PHP = Language(
    name="php",
    comment=r"^\s*(?://|#|/\*|\*)",
    assign=r"\$((?:this->)?\w+)\s*\.?=\s*([^=;>][^;]*);",
    token=r"\$(\w+)",
    literal=SINGLE,
    interpolation="",
    source=r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES|ENV)\b|\$HTTP_RAW_POST_DATA|file_get_contents\s*\(\s*[\"']php://input|\bgetenv\s*\(|\bgetallheaders\s*\(|\$argv\b",
    direct=r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES)\s*\[",
    killer=r"\b(?:intval|floatval|boolval|filter_var|filter_input|md5|sha1|hash|crypt|password_hash)\s*\("
           r"|\(\s*(?:int|integer|float|double|bool|boolean)\s*\)"
           r"|\b(?:mysqli?_(?:query|real_query|unbuffered_query|db_query|num_rows|affected_rows|insert_id|error|errno|field_count)"
           r"|mysqli?_fetch_(?:array|assoc|row|object)|pg_(?:query|num_rows|affected_rows|fetch_assoc|fetch_row)|sqlite_query)\s*\("
           r"|(?i:MongoDB\\BSON\\ObjectId|MongoId)|^[^\"']*[*/%][^\"']*$",
    safe_source=r"getenv\s*\(.*(?:REMOTE_ADDR|REMOTE_PORT|SERVER_ADDR|SERVER_PORT)",
    db_source=r"->fetch(?:_assoc|_object|_row|_array|All|_column|Column)?\s*\(|\bmysqli?_fetch_(?:assoc|object|array|row)\s*\(|\bpg_fetch_\w+\s*\(",
    function=r"\bfunction\s+(\w+)\s*\(([^)]*)\)",
    tainted_param=NEVER,
    all_params=True,
    safe_param=r"^(?:int|float|bool)\s",
    returns=r"^\s*return\s+(.+);",
)

CSHARP = Language(
    name="csharp",
    comment=r"^\s*(?://|/\*|\*)",
    assign=r"(?:^|[\s(])([\w.]+)\s*\+?=\s*([^=;>][^;]*);",
    token=r"([A-Za-z_]\w*)",
    literal=QUOTED,
    interpolation=r"\{([A-Za-z_][^{}]*)\}",
    source=r"\bRequest\s*\[|\bRequest\.(?:QueryString|Form|Cookies|Headers|Params|RawUrl|Url|Path)\b|HttpContext\.Current\.Request",
    direct=r"\bRequest\s*[\[.]",
    killer=NEVER,
    safe_source=NEVER,
    db_source=r"=\s*(?:await\s+)?(?:db|context|_context|_db)\.\w+\.(?:Find|FirstOrDefault|SingleOrDefault|First|FindAsync|FirstOrDefaultAsync)\s*\(",
    function=r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?(?:virtual\s+)?(?:override\s+)?\w+(?:<[^>]+>)?\s+(\w+)\s*\(([^)]*)\)",
    tainted_param=NEVER,
    all_params=True,
    safe_param=NEVER,
    returns=r"^\s*return\s+(.+);",
)

RUBY = Language(
    name="ruby",
    comment=r"^\s*#",
    assign=r"^\s*@{0,2}(\w+)\s*\+?=\s*([^=~>].*)$",
    token=r"([A-Za-z_]\w*)",
    literal=QUOTED,
    interpolation=r"#\{([^}]*)\}",
    source=r"\bparams\s*\[|\brequest\.|\bcookies\s*\[|\bsession\s*\[|\.query_parameters|\.request_parameters|\bARGV\b|\bgets\b|\bSTDIN\.",
    direct=r"\bparams\s*\[",
    killer=NEVER,
    safe_source=NEVER,
    db_source=r"=\s*\w+\.(?:find|find_by|find_or_create_by|find_or_initialize_by)\s*\(|=\s*\w+\.(?:first|last)\b|=\s*\w+\.where\s*\(.*\)\.first",
    function=r"^\s*def\s+(\w+)\s*\(([^)]*)\)",
    tainted_param=NEVER,
    all_params=True,
    safe_param=r"^self$",
    returns=r"^\s*return\s+(.+)$",
)

GO = Language(
    name="go",
    comment=r"^\s*(?://|/\*|\*)",
    assign=r"^\s*(?:var\s+)?([A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_][\w.]*)*)(?:\s+[\w.\[\]*]+)?\s*[:+]?=\s*([^=].*)$",
    token=r"([A-Za-z_]\w*)",
    literal=DOUBLE + r"|`[^`]*`",
    interpolation="",
    source=r"\b[rR](?:eq|equest)?\.(?:FormValue|PostFormValue|URL|Header|Body|Cookie|Cookies|Referer|UserAgent|PathValue|MultipartReader)\b"
           r"|\bc\.(?:Query|DefaultQuery|Param|Params|PostForm|DefaultPostForm|GetHeader|GetRawData|GetPostForm|QueryParam|QueryParams|ParamValues|FormValue|FormParams|Body|Cookies)\s*\("
           r"|\bmux\.Vars\(|\bchi\.URLParam\(|\bos\.Args\b|\bos\.Getenv\(",
    direct=r"\b[rR](?:eq|equest)?\.(?:FormValue|PostFormValue|URL|Header|Body)\b|\bos\.Args\b",
    killer=r"\bstrconv\.(?:Atoi|ParseInt|ParseFloat|ParseBool|ParseUint|ParseComplex|FormatInt|FormatFloat)\(|\bnet\.ParseIP\("
           r"|\buuid\.(?:Parse|MustParse)\(|\bfilepath\.(?:Base|Clean)\(|\bhtml\.EscapeString\(|\btemplate\.HTMLEscapeString\(|\bldap\.EscapeFilter\(",
    safe_source=NEVER,
    db_source=r"\.(?:QueryRow|Query|QueryContext|QueryRowContext|Select|Find|First|Last|Scan|Row)\s*\(",
    function=r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)",
    tainted_param=r"http\.Request|gin\.Context|echo\.Context|fiber\.Ctx",
    all_params=False,
    safe_param=r"http\.ResponseWriter",
    returns=r"^\s*return\s+(.+)$",
)

WEBCONFIG = Language(
    name="webconfig", comment=NEVER, assign=NEVER + "()()", token=r"([A-Za-z_]\w*)", literal=QUOTED,
    interpolation="", source=NEVER, direct=NEVER, killer=NEVER, safe_source=NEVER, db_source=NEVER,
    function=NEVER + "()()", tainted_param=NEVER, all_params=False, safe_param=NEVER, returns=NEVER + "()",
)

LANGUAGES = {l.name: l for l in (PYTHON, JAVASCRIPT, JAVA, PHP, CSHARP, RUBY, GO, WEBCONFIG)}

# Second-order labels that PHP decoders hand out, and access shapes.
LABEL_SEEDS = {
    "php": {"json": r"^\s*json_decode\s*\(", "unser": r"^\s*unserialize\s*\("},
}
# A right-hand side of this shape passes a second-order label from base (group 1) on.
ACCESS = {
    "python": r"^\s*([A-Za-z_]\w*)(?:\.\w+|\[['\"]\w+['\"]\])",
    "javascript": r"^\s*([A-Za-z_$][\w$]*)\.\w+",
    "java": r"^\s*(\w+)\.\w+\s*\(",
    "php": r"^\s*\$(\w+)(?:\s*\[\s*['\"]\w+['\"]\s*\]|->\w+)",
    "csharp": r"^\s*(\w+)\.\w+",
    "ruby": r"^\s*(\w+)(?:\.\w+|\s*\[\s*[:'\"]\w+)",
    "go": r"^\s*(\w+)\.\w+",
}

# Calls that clear a variable for one category only.
CATEGORY_SANITIZERS = {
    "php": {
        "SQL_INJECTION": r"\b(?:addslashes|mysqli?_real_escape_string|pg_escape_(?:string|literal))\s*\(",
        "COMMAND_INJECTION": r"\b(?:escapeshellarg|escapeshellcmd)\s*\(",
        "XSS": r"\b(?:htmlspecialchars|htmlentities|strip_tags|urlencode|rawurlencode)\s*\(",
    },
    "go": {"XSS": r"\burl\.QueryEscape\("},
}

# File extensions by language family.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".ts": "javascript", ".jsx": "javascript", ".tsx": "javascript",
    ".mjs": "javascript", ".java": "java", ".kt": "java", ".scala": "java", ".php": "php", ".php3": "php",
    ".php4": "php", ".php5": "php", ".phtml": "php", ".cs": "csharp", ".config": "webconfig", ".aspx": "csharp",
    ".ascx": "csharp", ".rb": "ruby", ".erb": "ruby", ".go": "go", ".html": "markup", ".htm": "markup",
    ".vue": "markup", ".svelte": "markup",
}
