"""PHP rules."""

from .model import CMD, CODE, DESER, LDAP, NOSQL, REDIR, SQL, SSTI, XPATH, XXE, Rule as R, pack

# Calls, keywords and shapes of safe query builders.
SQL_CALL = r"(?:mysql_query|mysqli_query|mysqli_real_query|pg_query|sqlite_query|mssql_query|odbc_exec|->query|->prepare|->exec)\s*\("
SQL_TEXT = r"(?i)(?:^|[^$\w])(?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION)\s|[\"'].*\b(?:FROM|WHERE)\b.*[\"']"
#: A query whose values are bound: placeholders, or a mapper's conditions.
BOUND = r"->\s*prepare\s*\(\s*[\"'][^\"']*(?:\?|:\w)|->(?:where|whereIn|orWhere|having)\s*\(\s*['\"]|->(?:bindValue|bindParam|execute)\s*\("
COMMANDS = r"\b(?:system|exec|shell_exec|passthru|popen|proc_open|pcntl_exec)\s*\("
ESCAPED = r"escapeshell(?:cmd|arg)\s*\("
FRAMEWORK_CALL = r"\$next\s*\(\s*\$request\s*\)|\$(?:callback|handler|resolver|this|self|parent|closure|next|pipe)\s*\("
NUMERIC_FORMAT = r"sprintf\s*\(\s*[\"'][^\"'%]*(?:%[-+0 #]*[0-9.]*[dioxXu][^\"'%]*)+[\"']"
PHAR_CALLS = r"\b(?:file_get_contents|file_exists|is_file|is_dir|fopen|file|readfile|copy|stat|lstat|fileatime|filectime|filemtime|filesize|getimagesize|highlight_file|show_source|parse_ini_file|exif_thumbnail|exif_imagetype|file_put_contents|unlink|rename|mkdir)\s*\("
MONGO_CALLS = r"->(?:find|findOne|aggregate|update|insert|insertOne|insertMany|remove|deleteOne|deleteMany|updateOne|updateMany|replaceOne|findOneAndUpdate|findOneAndDelete|count|countDocuments|distinct|bulkWrite|mapReduce)\s*\("
NOT_XPATH = r"(?i)\$pdo\s*->\s*query|\$\w*(?:db|conn|sql)\w*\s*->\s*query|\$mysqli\w*\s*->\s*query|mysqli_query\s*\(|->\s*prepare\s*\("
XPATH_CALL = r"(?i)\$\w+->(?:query|evaluate|xpath)\s*\("
INT_POSITION = r"\[\s*\"?\s*\.?\s*\$(?:pos|position|index|idx|i|n|num|count)\b|\[\s*\(\s*int(?:eger)?\s*\)\s*\$|\[\s*intval\s*\(\s*\$"

RULES = pack(
    "php",
    # Queries.
    R("php-sql", SQL, SQL_CALL + "|" + SQL_TEXT[4:], "Query with user data", "CRITICAL/HIGH", label="user", unless=BOUND + "|" + NUMERIC_FORMAT + r"|^\s*(?:\$\w+\s*=\s*)?(?:if\s*\()?\s*(?:mysqli?_query|pg_query|sqlite_query)\s*\(\s*\$\w+\s*,\s*\$sql",
      hit='mysqli_query($c, "SELECT * FROM t WHERE a=$v{a}");', miss='$st->prepare("SELECT * FROM t WHERE a=?");'),
    R("php-sql-numeric", SQL, r"(?i)" + NUMERIC_FORMAT, "Query formatted with numbers only", "MEDIUM/LOW", label="user", hit='$q{a} = sprintf("SELECT a FROM t WHERE i=%d", $v{a});'),
    R("php-sql-stored-write", SQL, r"(?i)(?:UPDATE|DELETE)\s+", "Stored value in a changing query", "CRITICAL/HIGH", label="db", hit='$q{a} = "UPDATE t SET n=$v{a}";', miss='$q{a} = "UPDATE t SET n=1";'),
    R("php-sql-json-calc", SQL, r"(?i)[\"'].*(?:SUM|COUNT|AVG|MIN|MAX)\s*\(\s*\$", "Decoded value in a calculation", "CRITICAL/HIGH", label="json", hit='$q{a} = "SELECT SUM($v{a}) FROM t";'),
    R("php-sql-json-structure", SQL, r"(?i)(?:ORDER|GROUP)\s+BY\s+\$", "Decoded value in query structure", "CRITICAL/HIGH", label="json", hit='$q{a} = "SELECT a FROM t ORDER BY $v{a}";'),
    R("php-sql-table", SQL, r"(?i)(?:FROM|INTO|UPDATE|JOIN)\s+\$", "Table named by data", "CRITICAL/HIGH", label="table,db,json", priority=1, hit='$q{a} = "SELECT a FROM $v{a}";', miss='$q{a} = "SELECT a FROM t";'),
    R("php-sql-stored-structure", SQL, r"(?i)(?:SUM|COUNT|AVG|MIN|MAX)\s*\(\s*\$|(?:ORDER|GROUP)\s+BY\s+\$", "Stored value in query structure", "CRITICAL/HIGH", label="db", hit='$q{a} = "SELECT a FROM t GROUP BY $v{a}";'),
    R("php-sql-unserialized", SQL, r"(?i)(?:mysqli?_query|pg_query|sqlite_query)\s*\(|\$\w+->(?:query|exec)\s*\(|->(?:raw|select|where|whereRaw|selectRaw)\s*\(|(?:DB|Database)::(?:query|select|raw|statement)\s*\(|[\"'](?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE).*\.\s*\$", "Unserialized value in a query", "CRITICAL/HIGH", label="unser",
      unless=r"(?i)prepare|bindParam|bindValue|execute\s*\(\s*\[|" + NUMERIC_FORMAT, hit='$db->query("SELECT a FROM t WHERE n=" . $v{a});'),
    R("php-sql-unserialized-numeric", SQL, r"(?i)" + NUMERIC_FORMAT, "Unserialized value formatted as a number", "MEDIUM/LOW", label="unser", hit="$q{a} = sprintf('DELETE FROM t WHERE i=%d', $v{a});"),
    R("php-sql-call", SQL, r"\b(?:mysqli?_query|mysqli_real_query|pg_query|sqlite_query|mysql_db_query)\s*\(|->(?:query|exec)\s*\(", "Query variable with user data", "CRITICAL/HIGH", label="user", unless=r"(?i)xpath|" + NUMERIC_FORMAT, priority=-1, hit="mysqli_query($c, $v{a});", miss='mysqli_query($c, "SELECT 1");'),
    R("php-sql-second-order", SQL, r"\b(?:mysqli?_query|pg_query)\s*\(|->(?:query|exec)\s*\(", "Query with a stored value", "HIGH/HIGH", label="db", unless=r"(?i)xpath", priority=-1, hit="$db->exec($v{a});", miss='$db->exec("SELECT 1");'),
    R("php-sql-prepare-text", SQL, r"(?i)\bSET\s+@\w+\s*=\s*\(\s*SELECT\b", "Statement text loaded by the database", "HIGH/MEDIUM", near=r"(?i)\bPREPARE\b.*\bFROM\b", near_frame=(0, 10), hit='$db->exec("SET @q = (SELECT s FROM t)");\n$db->exec("PREPARE st FROM @q");'),
    R("php-mongo-where", NOSQL, r"\[\s*['\"]\$where['\"]|return\s+this\.|this\.\w+\s*(?:[=!<>]=|&&|\|\|)", "Code in a query document", "CRITICAL/HIGH", label="user", hit='$c->findOne(["$where" => $v{a}]);', miss='$c->findOne(["$where" => "1"]);'),
    R("php-mongo-call", NOSQL, r"(?i)\$\w*(?:mongo|collection|db)\w*" + MONGO_CALLS, "Query document with user data", "CRITICAL/HIGH", label="user", hit="$collection->findOne(['n' => $v{a}]);", miss="$collection->findOne(['n' => 'x']);"),
    # Commands.
    R("php-command", CMD, COMMANDS, "Command with user data", "CRITICAL/HIGH", label="user", unless=ESCAPED, hit='system("ping " . $v{a});', miss='system("ping " . escapeshellarg($v{a}));'),
    R("php-command-variable", CMD, COMMANDS + r".*\$\w", "Command with a variable", "HIGH/MEDIUM", unless=ESCAPED, hit="passthru($cmd);", miss='passthru("ls");'),
    R("php-backtick", CMD, r"`[^`]*\$", "Command in backticks with user data", "CRITICAL/HIGH", label="user", hit="$o{a} = `ls $v{a}`;", miss="$o{a} = `ls`;"),
    R("php-variable-command", CMD, r"\$\w+\s*\(", "Function variable near a dangerous name", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", unless=FRAMEWORK_CALL, near=r"=\s*[\"'](?:system|exec|shell_exec|passthru|popen|proc_open|eval|assert)[\"']", near_frame=(-9, 0), hit='$f{a} = "system";\n$f{a}($v{a});', miss="$callback($x);"),
    R("php-process-shell", CMD, r"\b(?:popen|proc_open)\s*\(", "Shell with command flag", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", near=r"[\"'](?:/bin/sh|/bin/bash|sh|bash|cmd(?:\.exe)?)[\"'].*[\"'](?:-c|/c)[\"']", near_frame=(0, 3), hit="proc_open(['sh', '-c', $v{a}], $d, $p);"),
    R("php-hidden-call", CMD, r"\$\w+\s*\(", "Call through a reversed name", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", unless=FRAMEWORK_CALL, near=r"strrev\s*\(\s*[\"'](?:metsys|cexe|urhtssap|cexe_llehs|nepop|nepo_corp|lave|tressa)[\"']", near_frame=(-9, 0), priority=1, hit='$g{a} = strrev("metsys");\n$g{a}($v{a});'),
    # Code.
    R("php-strrev", CODE, r"(?i)strrev\s*\(\s*[\"'](?:metsys|cexe|urhtssap|cexe_llehs|nepop|nepo_corp|lave|tressa|noitcnuf_etaerc|edulcni|eriuqer)[\"']", "Reversed name of a dangerous function", "HIGH/HIGH", hit='$h{a} = strrev("lave");', miss='$h{a} = strrev("abc");'),
    R("php-eval", CODE, r"\beval\s*\(", "Data evaluated as code", "CRITICAL/HIGH", label="user", hit="eval($v{a});", miss="eval('return 1;');"),
    R("php-preg-e", CODE, r"preg_replace\s*\([^,]*/[a-zA-Z]*e[a-zA-Z]*[\"']", "Replacement evaluated as code", "CRITICAL/HIGH", hit='preg_replace("/x/e", $r, $s);', miss='preg_replace("/x/i", $r, $s);'),
    R("php-create-function", CODE, r"\b(?:create_function|assert)\s*\(", "Data evaluated as code", "CRITICAL/HIGH", label="user", hit="assert($v{a});", miss="assert(true);"),
    R("php-call-user", CODE, r"call_user_func(?:_array)?\s*\(", "Callback from user data", "CRITICAL/HIGH", label="user", hit="call_user_func($v{a});"),
    R("php-call-user-variable", CODE, r"call_user_func(?:_array)?\s*\(\s*(?:\$|\[)", "Callback is a variable", "HIGH/MEDIUM", hit="call_user_func($fn);", miss="call_user_func('trim');"),
    R("php-variable-function", CODE, r"\$\w+\s*\(", "Function name from user data", "CRITICAL/HIGH", label="user", unless=FRAMEWORK_CALL + r"|->\s*\$?\w+\s*\(", hit="$v{a}(1);", miss="$next($request);"),
    R("php-reflection", CODE, r"Reflection(?:Function|Method|Class)\s*\(", "Reflection on user data", "CRITICAL/HIGH", label="user", hit="new ReflectionFunction($v{a});"),
    R("php-array-callback", CODE, r"\barray_(?:map|filter|walk|reduce)\s*\(|\bu[ak]?sort\s*\(", "Array callback with user data", "HIGH/HIGH", label="user", hit="array_map($v{a}, $list);", miss="array_map('trim', $list);"),
    # Deserialization.
    R("php-unserialize", DESER, r"\bunserialize\s*\(", "Objects revived from data", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", unless=r"(?i)allowed_classes['\"]?\s*=>\s*(?:false|\[|array)|igbinary_unserialize", hit="unserialize($v{a});", miss="unserialize($v{a}, ['allowed_classes' => false]);"),
    R("php-decoders", DESER, r"\b(?:yaml_parse|yaml_parse_file|yaml_parse_url|igbinary_unserialize)\s*\(", "Objects revived from user data", "CRITICAL/HIGH", label="user", hit="yaml_parse($v{a});", miss="yaml_parse('a: 1');"),
    R("php-decoders-weak", DESER, r"\b(?:msgpack_unpack|wddx_deserialize)\s*\(", "Values decoded from user data", "HIGH/HIGH", label="user", hit="msgpack_unpack($v{a});"),
    R("php-json-class", DESER, r"\bjson_decode\s*\(", "Decoded user data may pick a class", "MEDIUM/LOW", label="user", near=r"new\s+\$", near_frame=(0, 10), hit="$d{a} = json_decode($v{a});\n$o{a} = new $d{a}();"),
    R("php-phar", DESER, PHAR_CALLS, "File path from user data may name an archive", "CRITICAL/MEDIUM", label="user", absent=r"(?i)phar.*(?:strpos|stripos|preg_match|str_starts_with)|(?:strpos|stripos|preg_match|str_starts_with).*phar", absent_frame=(-10, 0), hit="file_exists($v{a});", miss="file_exists('/x');"),
    R("php-phar-include", DESER, r"\b(?:include|include_once|require|require_once)\b\s*\(?\s*[^'\"\s(]", "Included path from user data", "CRITICAL/MEDIUM", label="user", hit="include $v{a};", miss="include 'x.php';"),
    R("php-gadget", DESER, r"function\s+__(?:wakeup|destruct|toString|call|callStatic|get|set|isset|unset|invoke)\s*\(", "Magic method with a dangerous call", "LOW/LOW", near=r"\b(?:exec|system|passthru|shell_exec|popen|proc_open|eval|assert|create_function|unlink|file_put_contents|fwrite|call_user_func|call_user_func_array|mail|preg_replace|pcntl_exec|putenv|apache_setenv)\s*\(", near_frame=(0, 10), hit="public function __wakeup() {\n  unlink($this->p);\n}"),
    # XML, templates, redirects, directories.
    R("php-xml-load", XXE, r"(?i)\$\w*(?:dom|xml|doc)\w*->(?:loadXML|loadHTML|load)\s*\(|\bsimplexml_load_(?:string|file)\s*\(", "XML from user data", "HIGH/HIGH", label="user", absent=r"libxml_disable_entity_loader\s*\(\s*true|LIBXML_NONET", absent_frame=(-15, 5), hit="$dom->loadXML($v{a});", miss="$dom->loadXML('<a/>');"),
    R("php-xml-reader", XXE, r"XMLReader::(?:open|xml)\s*\(", "XML reader on user data", "HIGH/MEDIUM", label="user", absent=r"libxml_disable_entity_loader\s*\(\s*true|LIBXML_NONET", absent_frame=(-15, 5), hit="XMLReader::open($v{a});"),
    R("php-xpath", XPATH, XPATH_CALL, "XPath from data", "CRITICAL/HIGH", label="user,db,json,unser", unless=NOT_XPATH + "|" + INT_POSITION, near=r"(?i)xpath|simplexml|evaluate", near_frame=(-5, 0), hit='$xml->xpath("//u[n=" . $v{a});', miss="$pdo->query($v{a});"),
    R("php-xpath-position", XPATH, XPATH_CALL, "XPath position from data", "MEDIUM/LOW", label="user,db", unless=NOT_XPATH, near=r"intval|\(\s*int(?:eger)?\s*\)", near_frame=(-5, 0), priority=-1, hit='$i{a} = (int) $v{a};\n$xml->xpath("//u[" . $v{a});'),
    R("php-xpath-tree", XPATH, r"(?i)\$\w*xpath\w*->(?:query|evaluate)\s*\(", "XPath with user data", "HIGH/HIGH", label="user", hit='$xpath->query("//u[" . $v{a});', miss="$xpath->query('//u');"),
    R("php-template", SSTI, r"(?i)\$\w*(?:twig|template|smarty|blade|mustache)\w*->(?:render|createTemplate|display|fetch)\s*\(|\bnew\s+Template\s*\(", "Template text from user data", "HIGH/HIGH", label="user", hit="$twig->createTemplate($v{a});", miss="$twig->render('x.html');"),
    R("php-redirect", REDIR, r"(?i)\bheader\s*\(\s*[\"']location\s*:", "Redirect from user data", "HIGH/HIGH", label="user", hit='header("Location: " . $v{a});', miss='header("Location: /x");'),
    R("php-ldap", LDAP, r"\bldap_(?:search|list|read)\s*\(", "Directory filter with user data", "HIGH/HIGH", label="user", unless=r"ldap_escape\s*\(", hit='ldap_search($c, $b, "(u=" . $v{a});', miss='ldap_search($c, $b, ldap_escape($v{a}));'),
)
