"""Java, Kotlin and Scala rules."""

from .model import CMD, CODE, DESER, IDOR, NOSQL, SQL, SSTI, XPATH, XXE, Rule as R, pack

# Keyword sets, parsers and evaluators.
SQL_WORD = r"(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|TRUNCATE|EXEC|EXECUTE)"
#: `execute` of a process, not of a statement.
PROCESS = r"\b(?:getRuntime|ProcessBuilder|CommandLine)\b"
QUERY_CALL = r"\.(?:executeQuery|execute|executeUpdate)\s*\("
#: Values are bound: a placeholder in a prepared text, or a setter by position or name.
BOUND = r"prepare(?:Statement|Call)\s*\(.*[?:]|\.set\w+\s*\(\s*(?:\d+|\"\w+\")\s*,"
NATIVE_QUERY = r"\.?(?:createNativeQuery|createQuery|createSQLQuery|nativeQuery|queryForObject|queryForList|queryForMap|jdbcTemplate\.(?:query|update|execute|batchUpdate))\s*\("
HARDENED = r"setFeature.*(?:disallow-doctype-decl|external-general-entities|external-parameter-entities|external)|setProperty.*(?:SUPPORT_DTD|IS_SUPPORTING_EXTERNAL_ENTITIES)"

RULES = pack(
    "java",
    # Queries.
    R("java-execute-tainted", SQL, QUERY_CALL, "Query text from user data", "CRITICAL/HIGH", label="user", unless=PROCESS + r"|\.executeQuery\s*\(\s*\)", absent=BOUND, absent_frame=(-9, 0), hit='stmt.executeQuery("select " + v{a});', miss="stmt.executeQuery();"),
    R("java-execute-dynamic", SQL, QUERY_CALL + r".*(?i:" + SQL_WORD + r").*(?:\+|concat|format)", "Query assembled from parts", "HIGH/MEDIUM", unless=PROCESS, absent=BOUND, absent_frame=(-9, 0), hit='stmt.execute("SELECT * FROM " + name);', miss='stmt.execute("SELECT 1");'),
    R("java-concat-tainted", SQL, r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|TABLE)\b.*\+", "Query concatenated with user data", "HIGH/HIGH", label="user", unless=PROCESS, hit='String q{a} = "SELECT * FROM t WHERE a=" + v{a};', miss='String q{a} = "SELECT * FROM t WHERE a=" + 5;'),
    R("java-format-numeric", SQL, r"(?i)String\.format\s*\(\s*\"[^\"%]*" + SQL_WORD + r"[^\"%]*(?:%[-+0 #]*[0-9.]*[dioxXu][^\"%]*)+\"", "Query formatted with numbers only", "LOW/LOW", label="user", hit='String q{a} = String.format("SELECT a FROM t WHERE i=%d", v{a});'),
    R("java-format-tainted", SQL, r"(?i)String\.format\s*\(\s*\"[^\"]*" + SQL_WORD + r"[^\"]*%[-+0 #]*[0-9.]*[^dioxXu0-9.\" ]", "Query formatted with user data", "HIGH/HIGH", label="user", hit='String q{a} = String.format("SELECT a FROM t WHERE n=%s", v{a});'),
    R("java-builder-tainted", SQL, r"\.append\s*\([^)]*\)", "User data appended to a query", "HIGH/HIGH", label="user", near=r"(?i)" + SQL_WORD, near_frame=(-4, 0), hit='sq{a}.append("SELECT * ");\nsq{a}.append(v{a});', miss="sx{a}.append(v{a});"),
    R("java-native-db", SQL, NATIVE_QUERY, "Query text from a stored value", "CRITICAL/HIGH", label="db", hit="em.createNativeQuery(v{a});", miss='em.createNativeQuery("select 1");'),
    R("java-native-user", SQL, NATIVE_QUERY, "Query text from user data", "CRITICAL/HIGH", label="user", hit="em.createQuery(v{a});", miss='em.createQuery("from T");'),
    R("java-concat-db", SQL, r"(?i)\b(?:SELECT|UPDATE|DELETE|ORDER\s+BY|WHERE)\b.*[\"']\s*\+", "Query concatenated with a stored value", "CRITICAL/HIGH", label="db", hit='String q{a} = "SELECT a FROM t ORDER BY " + v{a};', miss='String q{a} = "SELECT a FROM t ORDER BY " + col;'),
    R("java-criteria-db", SQL, r"root\.get\s*\(|cb\.(?:asc|desc)\s*\(", "Stored value picks a column", "CRITICAL/HIGH", label="db", hit="root.get(v{a});", miss='root.get("name");'),
    R("java-hql-function", SQL, r"(?i)function\s*\(\s*['\"]", "Stored value in a query function", "CRITICAL/HIGH", label="db", near=r"createQuery|createNativeQuery|HQL", near_frame=(-4, 5), hit="String h{a} = \"select function('\" + v{a};\nem.createQuery(h{a});"),
    R("java-table-db", SQL, r"(?i)(?:FROM|INTO|UPDATE|JOIN|TABLE)\s*[\"']\s*\+", "Stored value names a table", "CRITICAL/HIGH", label="db", priority=1, hit='String q{a} = "SELECT * FROM " + v{a};', miss='String q{a} = "SELECT * FROM " + t;'),
    R("java-query-annotation", SQL, r"@Query\s*\(.*(?:\"\s*\+|#\{|\$\{)", "Query annotation assembled from parts", "CRITICAL/HIGH", hit='@Query("select u from U u where u.n = " + N)', miss='@Query("select u from U u where u.n = ?1")'),
    R("java-query-annotation-native", SQL, r"@Query\s*\(.*nativeQuery\s*=\s*true", "Native query annotation without placeholders", "HIGH/MEDIUM", unless=r"\?[0-9]|:\w+", hit='@Query(value = "select * from u", nativeQuery = true)', miss='@Query(value = "select * from u where n = :n", nativeQuery = true)'),
    R("java-encoded", SQL, r"(?i)(?:URLDecoder\.decode|Base64.*decode|new\s+String\s*\(|StringEscapeUtils\.unescape|Normalizer\.normalize)", "Decoded user data near a query", "CRITICAL/HIGH", label="user,db", near=r"(?i)" + SQL_WORD + r"\b.*\+|executeQuery|createNativeQuery|createQuery", near_frame=(0, 5), hit="String d{a} = URLDecoder.decode(v{a});\nstmt.executeQuery(d{a});"),
    R("java-stream-db", SQL, r"\.(?:map|forEach|reduce|collect)\s*\(.*(?:->|::)", "Stored values flow through a stream into a query", "CRITICAL/HIGH", label="db", near=r"(?i)createNativeQuery|executeQuery|\bSELECT\b|ORDER\s+BY", near_frame=(-3, 5), hit='String c{a} = v{a}.stream().map(x -> x).collect(j);\nem.createNativeQuery("SELECT " + c{a});'),
    R("java-array-db", SQL, r"new\s+(?:String|Object)\s*\[\s*\]\s*\{|Arrays\.asList\s*\(|String\.join\s*\(", "Stored value hidden in an array", "CRITICAL/HIGH", label="db", near=r"(?i)createNativeQuery|executeQuery|\bSELECT\b|ORDER\s+BY", near_frame=(-3, 5), hit='String[] p{a} = new String[] { v{a} };\nem.createNativeQuery("SELECT " + p{a}[0]);'),
    # Commands.
    R("java-runtime-exec", CMD, r"Runtime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(", "Command from user data", "CRITICAL/HIGH", label="user", hit="Runtime.getRuntime().exec(v{a});", miss='Runtime.getRuntime().exec("ls");'),
    R("java-process-list", CMD, r"new\s+ProcessBuilder\s*\(\s*(?:Arrays\.asList\s*\(|List\.of\s*\(|new\s+ArrayList|command[sS]?\b|args\b|argList|cmdList)", "Argument list with user data", "MEDIUM/MEDIUM", label="user", hit='new ProcessBuilder(List.of("ls", v{a}));'),
    R("java-process", CMD, r"new\s+ProcessBuilder\s*\(", "Process from user data", "CRITICAL/HIGH", label="user", unless=r"new\s+ProcessBuilder\s*\(\s*(?:Arrays\.asList\s*\(|List\.of\s*\(|new\s+ArrayList|command[sS]?\b|args\b|argList|cmdList)", hit="new ProcessBuilder(v{a});", miss='new ProcessBuilder("ls");'),
    R("java-process-shell", CMD, r"new\s+ProcessBuilder\s*\(\s*[\"'](?:/bin/sh|/bin/bash|sh|bash|cmd(?:\.exe)?)[\"']", "Shell with command flag", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", near=r"[\"'](?:-c|/c|/k)[\"']", near_frame=(0, 3), hit='new ProcessBuilder("sh", "-c", v{a});', miss='new ProcessBuilder("sh");'),
    R("java-invoke-runtime", CMD, r"\.invoke\s*\(", "Process started by reflection", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", near=r"(?i)Runtime|ProcessBuilder|exec|getRuntime", near_frame=(-9, 1), hit='Method x{a} = Runtime.class.getMethod("exec");\nx{a}.invoke(r, v{a});', miss="bus.invoke(r);"),
    R("java-get-exec", CMD, r"\.get(?:Declared)?Method\s*\(\s*[\"']exec[\"']", "Name of exec looked up", "HIGH/HIGH", hit='k.getMethod("exec", String.class);', miss='k.getMethod("name");'),
    # Deserialization.
    R("java-base64-tainted", DESER, r"Base64\s*\.\s*getDecoder\s*\(\s*\)\s*\.\s*decode\s*\(", "User data decoded", "MEDIUM/MEDIUM", label="user", hit="byte[] b{a} = Base64.getDecoder().decode(v{a});"),
    R("java-read-untrusted", DESER, r"\w\s*\.\s*readObject\s*\(\s*\)", "Object read from untrusted data", "CRITICAL/HIGH", near=r"(?i)request\.|getParameter|getInputStream|blob|payload", near_frame=(-14, 2), absent=r"ValidatingObjectInputStream|ObjectInputFilter|setObjectInputFilter|createFilter", absent_frame=(-14, 2), hit="ObjectInputStream in{a} = new ObjectInputStream(payload);\nObject o{a} = in{a}.readObject();"),
    R("java-read-object", DESER, r"\w\s*\.\s*readObject\s*\(\s*\)", "Object read from a stream", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", near=r"ObjectInputStream", near_frame=(-14, 2), absent=r"ValidatingObjectInputStream|ObjectInputFilter|setObjectInputFilter|createFilter", absent_frame=(-14, 2), priority=-1, hit="ObjectInputStream is{a} = new ObjectInputStream(v{a});\nObject p{a} = is{a}.readObject();"),
    R("java-xml-decoder", DESER, r"XMLDecoder", "Objects decoded from XML", "CRITICAL/HIGH", hit="XMLDecoder d{a} = new XMLDecoder(in);", miss="XMLEncoder d{a} = new XMLEncoder(out);"),
    R("java-kryo", DESER, r"Kryo\s*\(\s*\)|\.readClassAndObject\s*\(|\.readObject\s*\(.*Kryo", "Objects decoded without class filter", "HIGH/MEDIUM", absent=r"setRegistrationRequired\s*\(\s*true", absent_frame=(0, 10), hit="Kryo k{a} = new Kryo();"),
    R("java-xstream", DESER, r"XStream\s*\(\s*\)|\.fromXML\s*\(", "Objects decoded from XML", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", absent=r"allowTypes|addPermission|denyTypes", absent_frame=(-9, 5), hit="xs.fromXML(v{a});", miss="xs.toXML(v{a});"),
    R("java-yaml-load", DESER, r"\.load(?:As|All)?\s*\(", "YAML loaded with object construction", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", near=r"import\s+org\.yaml\.snakeyaml|Yaml\s+\w+\s*=|new\s+Yaml\s*\(", near_frame=(-9, 1), absent=r"SafeConstructor|BaseConstructor|\w*[sS]afe\w*\s*\)", absent_frame=(-9, 1), hit="Yaml y{a} = new Yaml();\nObject z{a} = y{a}.load(v{a});"),
    R("java-yaml-new", DESER, r"new\s+Yaml\s*\(\s*\)", "YAML parser without safe constructor", "MEDIUM/MEDIUM", absent=r"SafeConstructor|BaseConstructor", absent_frame=(-2, 3), hit="Yaml w{a} = new Yaml();", miss="Yaml w{a} = new Yaml(new SafeConstructor());"),
    R("java-json-typing", DESER, r"enableDefaultTyping\s*\(|activateDefaultTyping\s*\(|@JsonTypeInfo\s*\(.*Id\.CLASS", "Type names taken from data", "HIGH/HIGH", hit="mapper.enableDefaultTyping();", miss="mapper.disableDefaultTyping();"),
    # XML.
    R("java-xml-factory", XXE, r"(?:DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)\s*\.\s*newInstance\s*\(", "XML factory without protection", "HIGH/HIGH", absent=HARDENED, absent_frame=(1, 10), hit="SAXParserFactory s{a} = SAXParserFactory.newInstance();"),
    R("java-xml-transformer", XXE, r"(?:TransformerFactory|SchemaFactory)\s*\.\s*newInstance\s*\(|new\s+(?:SAXReader|SAXBuilder)\s*\(", "XML reader without protection", "HIGH/MEDIUM", absent=r"setFeature|setAttribute|ACCESS_EXTERNAL|FEATURE_SECURE_PROCESSING", absent_frame=(1, 10), hit="SAXReader r{a} = new SAXReader();"),
    # Expressions, scripts, reflection.
    R("java-jndi", CODE, r"\.lookup\s*\(", "Directory lookup with user data", "CRITICAL/HIGH", label="user", near=r"InitialContext|Context|JndiTemplate", near_frame=(-4, 1), hit="Context c{a} = new InitialContext();\nc{a}.lookup(v{a});", miss="table.find(v{a});"),
    R("java-spel", CODE, r"SpelExpressionParser|ExpressionParser|parseExpression|StandardEvaluationContext", "Expression from user data", "CRITICAL/HIGH", label="user", hit="parser.parseExpression(v{a});", miss='parser.parseExpression("1 + 1");'),
    R("java-spel-near", CODE, r"parseExpression\s*\(", "Expression near request data", "HIGH/MEDIUM", near=r"request\.|@RequestParam|@PathVariable|getParameter", near_frame=(-4, 1), priority=-1, hit='String z{a} = request.getParameter("z");\nparser.parseExpression(expr);'),
    R("java-ognl", CODE, r"OgnlContext|Ognl\.(?:getValue|setValue)|OgnlUtil|ValueStack", "Expression evaluated", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", hit="Ognl.getValue(v{a}, root);", miss="value.get(root);"),
    R("java-mvel", CODE, r"MVEL\.(?:eval|compileExpression)|MVELInterpretedRuntime", "Expression from user data", "CRITICAL/HIGH", label="user", hit="MVEL.eval(v{a});", miss='MVEL.eval("1");'),
    R("java-el", CODE, r"ELProcessor|ExpressionFactory|ValueExpression|MethodExpression", "Expression from user data", "CRITICAL/HIGH", label="user", hit="new ELProcessor().eval(v{a});"),
    R("java-class-loader", CODE, r"URLClassLoader|new\s+URL\s*\([^)]*\)\s*.*\.loadClass", "Classes loaded from an address", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", hit="new URLClassLoader(v{a});"),
    R("java-base64-script", CODE, r"Base64\s*\.\s*getDecoder\s*\(\s*\)\s*\.\s*decode\s*\(", "Decoded user data near a script engine", "CRITICAL/HIGH", label="user", near=r"ScriptEngine|\.eval\s*\(", near_frame=(0, 10), hit="byte[] s{a} = Base64.getDecoder().decode(v{a});\nengine.eval(new String(s{a}));"),
    R("java-script-eval", CODE, r"\.eval\s*\(", "Script from user data", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", unless=r"\.eval\s*\(\s*[\"'][^\"']*[\"']\s*\)|MVEL", near=r"ScriptEngine|getEngineByName", near_frame=(-4, 1), hit='ScriptEngine e{a} = m.getEngineByName("js");\ne{a}.eval(v{a});'),
    R("java-script-literal", CODE, r"\.eval\s*\(\s*[\"'][^\"']*[\"']\s*\)", "Fixed script evaluated", "LOW/LOW", near=r"ScriptEngine|getEngineByName", near_frame=(-4, 1), hit='ScriptEngine f{a} = m.getEngineByName("js");\nf{a}.eval("1");'),
    R("java-script-chain", CODE, r"ScriptEngineManager\s*\(\s*\)\s*\.\s*getEngineByName\s*\([^)]+\)\s*\.\s*eval\s*\(", "Script engine called in one chain", "CRITICAL/HIGH", label="user", priority=1, hit='new ScriptEngineManager().getEngineByName("js").eval(v{a});'),
    R("java-for-name", CODE, r"Class\s*\.\s*forName\s*\(", "Class name from user data", "CRITICAL/HIGH", label="user", hit="Class.forName(v{a});", miss='Class.forName("x.Y");'),
    R("java-invoke", CODE, r"\.invoke\s*\(", "Method called by reflection with user data", "HIGH/HIGH", label="user", near=r"get(?:Declared)?Method|Method\s+\w+", near_frame=(-4, 1), hit='Method m{a} = k.getMethod("run");\nm{a}.invoke(o, v{a});'),
    R("java-new-instance", CODE, r"\.newInstance\s*\(", "Object created by reflection with user data", "HIGH/HIGH", label="user", near=r"get(?:Declared)?Constructor|Constructor", near_frame=(-4, 1), hit="Constructor c{a} = k.getConstructor();\nc{a}.newInstance(v{a});"),
    R("java-reflect-query", SQL, r"\.(?:invoke|getMethod|getDeclaredMethod)\s*\(", "Query method reached by reflection", "CRITICAL/HIGH", label="user,db", near=r"(?i)createNativeQuery|executeQuery|createQuery|\bSELECT\b", near_frame=(-9, 3), hit='Method q{a} = em.getClass().getMethod("createNativeQuery");\nq{a}.invoke(em, v{a});'),
    R("java-native", CODE, r"\bnative\b\s+\w+\s+\w+\s*\(", "Native method declared", "MEDIUM/MEDIUM", hit="public native int f{a}(String s);"),
    R("java-load-library", CODE, r"System\s*\.\s*loadLibrary\s*\(", "Native library loaded", "HIGH/HIGH", hit='System.loadLibrary("x");'),
    R("java-load", CODE, r"System\s*\.\s*load\s*\(", "Native library loaded by path", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", hit="System.load(v{a});"),
    # Templates, documents, entities.
    R("java-template", SSTI, r"new\s+Template\s*\(|Velocity\.evaluate\s*\(|\.getTemplate\s*\(|templateEngine\.process\s*\(|StringTemplateLoader|\.putTemplate\s*\(|compileInline\s*\(|PebbleEngine|Mustache.*compile\s*\(", "Template text from user data", "CRITICAL/HIGH", label="user", hit='new Template("x", v{a});', miss='new Template("x", "y");'),
    R("java-mongo", NOSQL, r"BasicDBObject\.parse\s*\(|Document\.parse\s*\(|BasicQuery\s*\(|\$where", "Query document from user data", "CRITICAL/HIGH", label="user", hit="Document.parse(v{a});", miss='Document.parse("{}");'),
    R("java-mongo-call", NOSQL, r"\b(?:collection|coll|mongoTemplate)\w*\.(?:find|aggregate|updateOne|deleteOne|countDocuments)\s*\(", "Query document from user data", "CRITICAL/HIGH", label="user", unless=r"Filters\.eq\s*\(", hit="collection.find(v{a});", miss='collection.find(Filters.eq("n", v{a}));'),
    R("java-xpath", XPATH, r"\.(?:evaluate|compile|selectNodes|selectSingleNode)\s*\(", "XPath from user data", "HIGH/HIGH", label="user", near=r"(?i)xpath", near_frame=(-9, 1), hit="XPath x{a} = f.newXPath();\nx{a}.evaluate(v{a}, doc);", miss="Pattern.compile(v{a});"),
    R("java-xpath-db", XPATH, r"\.(?:evaluate|compile|selectNodes|selectSingleNode)\s*\(|xpath.*\+", "XPath from a stored value", "CRITICAL/HIGH", label="db", near=r"(?i)xpath", near_frame=(-9, 1), hit="XPath w{a} = f.newXPath();\nw{a}.compile(v{a});"),
    R("java-xpath-concat", XPATH, r"[\"']//[^\"']*[\"']\s*\+", "XPath text concatenated", "MEDIUM/MEDIUM", hit='String p{a} = "//user[" + name;', miss='String p{a} = "//user";'),
    R("java-mass-assignment", IDOR, r"\.(?:save|saveAndFlush|persist|merge)\s*\(\s*\w+\s*\)", "Request body saved as an entity", "HIGH/HIGH", label="user", near=r"@RequestBody", near_frame=(-9, 0), hit="public void put{a}(@RequestBody User v{a}) {\n    repo.save(v{a});", miss="repo.save(copy);"),
)
