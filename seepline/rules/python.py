"""Python rules."""

from .names import FLAGS, SHELLS, any_of, names_of
from .model import AUTH, CMD, CODE, DESER, LDAP, NOSQL, SQL, SSTI, XPATH, XXE, Rule as R, pack

SHELL = r"""\[\s*["'](?:[\w/]*/)?""" + any_of(SHELLS) + r"""["']\s*,\s*["']""" + any_of(FLAGS) + r"""["']"""
PROCESS_CALLS = "(?:" + names_of("subprocess") + ")"
#: A line that names a way to run data.
RUNS = r"\b(?:subprocess|" + names_of("os", "subprocess", "builtins") + r")\b"
#: A statement that reports instead of querying.
REPORTS = r"^\s*(?:raise|assert|print|log\w*\.\w+)\b"
PLACEHOLDERS = r":[A-Za-z_]\w*|[^%\w]\?|%\(\w+\)s|%s"
#: A query over a mapped class, and the import that tells of mapped classes.
MAPPED_QUERY = r"\.query\s*\(\s*[A-Z]\w*\s*[,.)]"
MAPPER = r"\bsqlalchemy\b"
ALLOW_LIST = r"\bif\s+\w+\s+(?:not\s+)?in\s+(?:\[|\{|\(|\w+)"

RULES = pack(
    "python",
    # Dynamic access to dangerous functions.
    R("py-getattr-process", CMD, r"\bgetattr\s*\(\s*(?:subprocess|os)\s*,\s*[\"'](?:" + names_of("os", "subprocess") + r")[\"']",
      "Dangerous function reached through getattr", "HIGH/HIGH",
      hit='f{a} = getattr(os, "system")', miss='f{a} = getattr(os, "getcwd")'),
    R("py-getattr-builtin", CODE, r"\bgetattr\s*\(\s*(?:builtins|pickle|marshal|yaml)\s*,\s*[\"'](?:" + names_of("builtins", "pickle", "marshal", "yaml") + r")[\"']",
      "Dangerous function reached through getattr", "HIGH/HIGH",
      hit='f{a} = getattr(pickle, "loads")', miss='f{a} = getattr(pickle, "dumps")'),
    R("py-getattr-process-name", CMD, r"\bgetattr\s*\(\s*(?:subprocess|os)\s*,\s*[A-Za-z_]\w*", "Attribute name of a process module is dynamic",
      "CRITICAL/HIGH", label="user", plain="MEDIUM/MEDIUM", hit="g{a} = getattr(os, v{a})"),
    R("py-getattr-builtin-name", CODE, r"\bgetattr\s*\(\s*(?:builtins|pickle|marshal|yaml)\s*,\s*[A-Za-z_]\w*", "Attribute name of a dangerous module is dynamic",
      "CRITICAL/HIGH", label="user", plain="MEDIUM/MEDIUM", hit="g{a} = getattr(builtins, v{a})"),
    R("py-eval", CODE, r"(?:^|\W)(?:eval|exec|compile)\s*\(", "Data evaluated as code", "CRITICAL/HIGH", label="user", plain="MEDIUM/LOW",
      unless=r"\bre\.compile\s*\(", hit="eval(v{a})", miss="p{a} = re.compile(v{a})"),
    R("py-execfile", CODE, r"\bexecfile\s*\(", "File run as code", "CRITICAL/HIGH", label="user", plain="MEDIUM/LOW", hit="execfile(v{a})", miss="profile(v{a})"),
    R("py-commands", CMD, r"\b(?:commands|subprocess)\.get(?:status)?output\s*\(", "Shell command from user data", "CRITICAL/HIGH", label="user",
      hit="commands.getoutput(v{a})", miss='commands.getoutput("date")'),
    R("py-os-system", CMD, r"(?:^|\W)system\s*\(", "Shell command from user data", "CRITICAL/HIGH", label="user",
      unless=r"\bquote\s*\(", hit='os.system("ping " + v{a})', miss='os.system(f"ping {shlex.quote(v{a})}")'),
    R("py-popen", CMD, r"(?:^|\W)popen[234]?\s*\(", "Shell command from user data", "CRITICAL/HIGH", label="user",
      hit="os.popen(v{a})", miss='os.popen("date")'),
    R("py-shell-true", CMD, r"\b(?:subprocess\.\w+|" + PROCESS_CALLS + r")\s*\(.*shell\s*=\s*True", "Process started through a shell",
      "CRITICAL/HIGH", label="user", plain="MEDIUM/MEDIUM", hit="subprocess.run(v{a}, shell=True)", miss="subprocess.run([v{a}])"),
    R("py-shell-argv", CMD, r"\(\s*" + SHELL, "Shell with command flag started from a list", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH",
      unless=r"shell\s*=\s*True", hit='subprocess.call(["/bin/sh", "-c", v{a}])', miss='subprocess.call(["ls", "-c", v{a}])'),
    R("py-ssh-argument", CMD, r"\b(?:subprocess\.)?" + PROCESS_CALLS + r"\s*\(\s*[A-Za-z_]\w*\s*[,)]", "Options injected into a remote shell command",
      "CRITICAL/HIGH", unless=r"shell\s*=\s*True", near=r"=\s*f[\"'].*\bssh\b.*\{.*\}", near_frame=(-14, 0),
      absent=r"^\s*def\s", absent_frame=(-2, 0), priority=1,
      hit='cmd{a} = f"ssh {v{a}} uptime"\nargs{a} = shlex.split(cmd{a})\nsubprocess.check_output(args{a})', miss="subprocess.check_output(args{a})"),
    R("py-split-argument", CMD, r"\b(?:subprocess\.)?" + PROCESS_CALLS + r"\s*\(\s*[A-Za-z_]\w*\s*[,)]", "Arguments injected into a command string",
      "HIGH/HIGH", unless=r"shell\s*=\s*True", near=r"=\s*shlex\.split\s*\(", near_frame=(-14, 0),
      hit='tool{a} = f"convert {v{a}}"\nargv{a} = shlex.split(tool{a})\nsubprocess.check_call(argv{a})', miss="subprocess.check_call(argv{a})"),
    # Queries.
    R("py-execute-tainted", SQL, r"\.?\bexecute(?:many|script)?\s*\(", "Query text from user data", "CRITICAL/HIGH", label="user",
      unless=r"(?:" + PLACEHOLDERS + r").*[\"']\s*,", hit='cursor.execute("SELECT * FROM t WHERE a = " + v{a})',
      miss='cursor.execute("SELECT * FROM t WHERE a = ?", (v{a},))'),
    R("py-execute-dynamic", SQL, r"\bexecute(?:many|script)?\s*\(\s*(?:f[\"']|[\"'].*[\"']\s*(?:%|\+)\s*\w|.*\.format\s*\()", "Query assembled from parts",
      "HIGH/MEDIUM", unless=r"(?:" + PLACEHOLDERS + r").*[\"']\s*,", hit='cursor.execute(f"SELECT * FROM {name}")', miss='cursor.execute("SELECT 1")'),
    R("py-raw-sql", SQL, r"\b(?:raw|RawSQL|extra)\s*\(", "Raw query from user data", "CRITICAL/HIGH", label="user",
      hit="User.objects.raw(v{a})", miss='User.objects.raw("SELECT 1")'),
    R("py-reduce-sql", SQL, r"\breduce\s*\(", "Query built by reduce", "HIGH/HIGH", near=r"(?i)SELECT|INSERT|UPDATE|DELETE|FROM|WHERE", near_frame=(-4, 3),
      hit='q{a} = reduce(lambda x, y: x + y, ["SELECT ", cols])'),
    R("py-yield-sql", SQL, r"(?i)yield\s+(?:query|sql)", "Query built by a generator", "HIGH/MEDIUM", hit="    yield sql", miss="    yield row"),
    R("py-lambda-sql", SQL, r"(?i)lambda.*f[\"'].*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)", "Query interpolated in a lambda", "HIGH/HIGH",
      hit='mk{a} = lambda n: f"SELECT * FROM {n}"', miss="mk{a} = lambda n: n + 1"),
    R("py-fstring-sql", SQL, r"(?i)f[\"'].*(?:SELECT\s+.*\s+FROM\s|INSERT\s+INTO\s|UPDATE\s+\w+\s+SET\s|DELETE\s+FROM\s|(?:SELECT|INSERT|UPDATE|DELETE)\s.*WHERE\s).*\{", "Query interpolated in an f-string",
      "HIGH/HIGH", unless=REPORTS, hit='sql{a} = f"SELECT * FROM t WHERE id = {v{a}}"', miss='raise ValueError(f"Unable to UPDATE t SET {v{a}}")'),
    # Deserialization.
    R("py-pickle", DESER, r"\b_?c?[pP]ickle\.loads?\s*\(", "Pickle data loaded", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM",
      hit="pickle.loads(v{a})", miss="pickle.dumps(v{a})"),
    R("py-shelve", DESER, r"\bshelve\.open\s*\(", "Shelf of pickled values opened", "CRITICAL/HIGH", label="user", plain="MEDIUM/LOW",
      hit="shelve.open(v{a})", miss="shelve.close(v{a})"),
    R("py-yaml", DESER, r"\byaml\.(?:load|unsafe_load|full_load)(?:_all)?\s*\(", "YAML loaded with object construction", "CRITICAL/HIGH", label="user",
      plain="HIGH/MEDIUM", unless=r"Safe", hit="yaml.load(v{a})", miss="yaml.load(v{a}, Loader=yaml.SafeLoader)"),
    R("py-marshal", DESER, r"\bmarshal\.loads?\s*\(", "Marshal data loaded", "CRITICAL/HIGH", label="user", hit="marshal.loads(v{a})", miss="marshal.loads(CONST)"),
    R("py-pickle-hidden", DESER, r"\.loads\s*\(", "Loader with a hidden pickle reference", "CRITICAL/HIGH", near=r"pickle|cvpxyr|7069636b6c65", near_frame=(-4, 1), priority=-1,
      hit='m{a} = __import__("cvpxyr")\nm{a}.loads(blob)'),
    # Templates.
    R("py-template", SSTI, r"\bTemplate\s*\(", "Template text from user data", "CRITICAL/HIGH", label="user", hit="Template(v{a}).render()", miss='Template("hi").render()'),
    R("py-from-string", SSTI, r"\bfrom_string\s*\(", "Template text from user data", "CRITICAL/HIGH", label="user", hit="env.from_string(v{a})", miss='env.from_string("hi")'),
    R("py-render-string", SSTI, r"\brender_template_string\s*\(", "Template text from user data", "CRITICAL/HIGH", label="user",
      hit="render_template_string(v{a})", miss='render_template_string("hi")'),
    R("py-format-map", SSTI, r"\.format_map\s*\(", "Format template may be user-controlled", "HIGH/MEDIUM", hit="out{a} = tpl.format_map(ctx)", miss="out{a} = tpl.format(ctx)"),
    R("py-dunder-format", SSTI, r"\{[^}]*\.__class__|__mro__|__subclasses__|__globals__|__getattribute__", "Attribute chain that leaves a sandbox", "CRITICAL/HIGH",
      hit='t{a} = "{x.__class__}"', miss='t{a} = "{x.name}"'),
    # XML and LDAP.
    R("py-xpath", XPATH, r"\.(?:xpath|find|findall|findtext|iterfind)\s*\(", "XPath from user data", "HIGH/HIGH", label="user",
      hit="tree.xpath(v{a})", miss='tree.xpath("//a")'),
    R("py-xpath-dynamic", XPATH, r"\.(?:xpath|find|findall|findtext|iterfind)\s*\(\s*(?:f[\"']|[\"'][^\"']*[\"']\s*[%+])", "XPath assembled from parts", "MEDIUM/MEDIUM",
      hit='tree.xpath("//u[@n=" + name + "]")', miss="tree.xpath(expr)"),
    R("py-xml-parse", XXE, r"\b(?:xml|etree|ElementTree|minidom|ET)\b[\w.]*\.(?:parse|fromstring|parseString|iterparse)\s*\(", "XML parsed without entity protection", "MEDIUM/MEDIUM",
      unless=r"(?i)defused", hit="doc{a} = etree.fromstring(body)", miss="doc{a} = defusedxml.etree.fromstring(body)"),
    R("py-xml-options", XXE, r"\bXMLParser\s*\(", "XML parser with entities or network switched on", "CRITICAL/HIGH",
      near=r"resolve_entities\s*=\s*True|load_dtd\s*=\s*True|no_network\s*=\s*False", near_frame=(0, 2),
      hit="parser{a} = XMLParser(resolve_entities=True)", miss="parser{a} = XMLParser(huge_tree=False)"),
    R("py-ldap", LDAP, r"(?:ldap|LDAP).*(?:f[\"'].*\{.*\}|%\s*\(|\.format\s*\()", "LDAP filter assembled from parts", "HIGH/HIGH",
      hit='ldap_conn.search(f"(uid={v{a}})")', miss='ldap_conn.search("(uid=root)")'),
    R("py-mongo-dict", NOSQL, r"(?i)\{.*\bfor\b.*\bin\b.*(?:user|query|request|input)", "Query document built from user data", "HIGH/MEDIUM",
      near=r"\.find\s*\(|\.find_one\s*\(|\.aggregate\s*\(", near_frame=(1, 5), hit="flt{a} = {k: w for k, w in user_data}\nrows{a} = coll.find(flt{a})"),
    R("py-jwt", AUTH, r"\bjwt\.decode\s*\(.*verify\w*[\"']?\s*[=:]\s*False", "Token decoded without verification", "CRITICAL/HIGH",
      hit="claims{a} = jwt.decode(tok, verify=False)", miss="claims{a} = jwt.decode(tok, KEY)"),
    # Evasion.
    R("py-rot13", CODE, r"codecs\.decode\s*\([^,]+,\s*[\"']rot.?13[\"']", "Text hidden by rotation", "HIGH/HIGH",
      hit='n{a} = codecs.decode("flfgrz", "rot13")', miss='n{a} = codecs.decode(raw, "utf-8")'),
    R("py-b64-sink", CMD, r"base64\.b64decode\s*\(", "Decoded data near a sink", "HIGH/HIGH", unless=r"#.*base64", near=RUNS, near_frame=(-2, 10),
      hit='c{a} = base64.b64decode("bHM=")\nos.popen(c{a})'),
    R("py-hex", CODE, r"\.fromhex\s*\(", "Text hidden in hex", "MEDIUM/MEDIUM", hit='h{a} = bytes.fromhex("6c73").decode()', miss='h{a} = float.hex(1.0)'),
    R("py-import-call", CODE, r"__import__\s*\(", "Module imported by call", "HIGH/HIGH", unless=r"[\"'].*__import__.*[\"']",
      hit='mod{a} = __import__("os")', miss="x{a} = '__import__(' + \"'\""),
    R("py-getattr-decoded", CODE, r"\bgetattr\s*\([^,]+,\s*[^)]*\)", "Attribute name is decoded text", "HIGH/HIGH", near=r"(?i)getattr.*(?:decode|b64|fromhex|r13)", near_frame=(-2, 1),
      hit='k{a} = getattr(mod, b64decode("c3lzdGVt"))', miss='k{a} = getattr(mod, "name")'),
    R("py-getattr-tainted", CODE, r"\bgetattr\s*\(\s*\w+\s*,\s*[A-Za-z_]\w*\s*\)", "Attribute name from user data", "CRITICAL/HIGH", label="user",
      unless=r"getattr\s*\(\s*(?:math|string|json|datetime|collections|itertools|functools|operator|re|logging|logger)\s*,",
      absent=ALLOW_LIST, absent_frame=(-9, 0), hit="m{a} = getattr(obj, v{a})", miss="m{a} = getattr(math, v{a})"),
    R("py-getattr-derived", CODE, r"\bgetattr\s*\(\s*\w+\s*,\s*[A-Za-z_]\w*\s*\)", "Attribute name derived from a lookup", "HIGH/HIGH",
      unless=r"getattr\s*\(\s*(?:math|string|json|datetime|collections|itertools|functools|operator|re|logging|logger)\s*,",
      near=r"\w+\s*=\s*(?:\w+\.get\s*\(|request\.|input\s*\(|\w+\[)", near_frame=(-9, 0), absent=ALLOW_LIST, absent_frame=(-9, 0),
      hit='act{a} = body.get("action")\nm{a} = getattr(obj, act{a})'),
    R("py-metaclass", CODE, r"metaclass\s*=|class\s+\w+Meta\s*\(\s*type\s*\)", "Metaclass may run code", "CRITICAL/HIGH", near=r"def\s+__call__.*\b(?:eval|exec|__import__|getattr)\b", near_frame=(0, 20),
      hit="class AMeta(type):\n    def __call__(cls): exec(src)"),
    R("py-descriptor", CODE, r"def\s+__get__\s*\(", "Descriptor runs code", "CRITICAL/HIGH", near=r"\b(?:" + names_of("builtins") + r")\s*\(", near_frame=(0, 15),
      hit="    def __get__(self, o, t): return eval(o.x)"),
    R("py-context-manager", CMD, r"@contextmanager", "Command hidden in a context manager", "HIGH/HIGH", unless=r"re\.(?:search|match|compile|findall)",
      near=r"(?i)subprocess|Popen|os\.system|shell", near_frame=(0, 15), hit="@contextmanager\ndef tool{a}(x): yield subprocess.run(x)"),
    R("py-getattr-proxy", CMD, r"def\s+__getattr__\s*\(", "Attribute proxy builds commands", "HIGH/HIGH", near=r"(?i)subprocess|system|popen|shell|command|cmd", near_frame=(0, 15),
      hit="    def __getattr__(self, cmd): return run(cmd)"),
    R("py-chainmap", CODE, r"ChainMap\s*\(", "Mapping chain with special names", "HIGH/HIGH", near=r"__class__|__globals__|__builtins__", near_frame=(-2, 5),
      hit='cm{a} = ChainMap(scope, {"__builtins__": b})'),
    R("py-builtins", CODE, r"__builtins__\s*\[|__builtins__\s*\.\s*__dict__\s*\[|__builtins__\s*\.get\s*\(", "Direct access to builtins", "CRITICAL/HIGH",
      hit='b{a} = __builtins__["eval"]', miss="b{a} = builtins.len"),
    R("py-globals", CODE, r"(?:globals|locals)\s*\(\s*\)\s*\[", "Function looked up by name", "HIGH/HIGH", hit="fn{a} = globals()[name]", miss="fn{a} = globals()"),
    R("py-subclasses", CODE, r"__subclasses__\s*\(\s*\)", "Class enumeration", "CRITICAL/HIGH", hit="kl{a} = object.__subclasses__()", miss="kl{a} = object.__name__"),
    R("py-vars", CODE, r"\bvars\s*\([^)]*\)\s*\[", "Attribute table read with user data", "HIGH/HIGH", label="user", hit="w{a} = vars(obj)[v{a}]", miss='w{a} = vars(obj)["x"]'),
    R("py-importlib", CODE, r"importlib\.import_module\s*\(", "Module name from user data", "CRITICAL/HIGH", label="user",
      hit="importlib.import_module(v{a})", miss='importlib.import_module("json")'),
    R("py-exec-compile", CODE, r"(?:exec|eval)\s*\(\s*compile\s*\(", "Code compiled and run in one step", "CRITICAL/HIGH", hit='exec(compile(src, "x", "exec"))'),
    R("py-type-class", CODE, r"\btype\s*\(\s*[^,]+,\s*\([^)]*\)\s*,\s*\{", "Class created at run time", "HIGH/MEDIUM", hit='K{a} = type("K", (object,), {"x": 1})', miss="K{a} = type(obj)"),
    R("py-join-sink", CMD, r"[\"']\s*\.join\s*\(", "Text joined near a sink", "HIGH/MEDIUM", near=r"(?i)subprocess|system|popen|eval|exec|shell", near_frame=(-1, 3),
      hit='j{a} = " ".join(parts)\nos.popen(j{a})'),
    # Second order.
    R("py-df-query", CODE, r"\.query\s*\(", "Stored value evaluated by a frame query", "CRITICAL/HIGH", label="db", unless=MAPPED_QUERY, absent=MAPPER, absent_frame=(-9, 0),
      hit="frame.query(v{a})", miss='frame.query("a > 1")'),
    R("py-df-eval", CODE, r"\.eval\s*\(", "Stored value evaluated by a frame", "CRITICAL/HIGH", label="db", unless=r"\.eval\s*\(\s*[\"']",
      hit="frame.eval(v{a})", miss='frame.eval("a + 1")'),
    R("py-pd-eval", CODE, r"\b(?:pd|pandas)\.eval\s*\(", "Stored value evaluated", "CRITICAL/HIGH", label="db", priority=1, hit="pd.eval(v{a})", miss='pd.eval("1 + 1")'),
)
