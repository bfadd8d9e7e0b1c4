"""C# and ASP.NET rules."""

from .model import AUTH, CMD, CODE, DESER, LDAP, SQL, SSTI, WHOLE, XPATH, XXE, Rule as R, pack

# Keyword sets, tools and call shapes.
SQL_WORD = r"(?:SELECT|INSERT|UPDATE|DELETE|DROP|EXEC|EXECUTE|FROM|WHERE|INTO)"
SQL_SINK = r"\.Execute(?:Reader|NonQuery|Scalar)\s*\(|SqlCommand\s*\(|\.CommandText\s*="
UNSAFE_TEXT = r"[\"'].*\+|\+.*[\"']|\$@?\"|[Ss]tring\.Format\s*\("
TOOLS = r"(?:ping|ipconfig|ifconfig|nslookup|tracert|traceroute|netstat|whoami|hostname|git|svn|curl|wget|ssh|scp|ftp|telnet|nmap|dig|arp|route|systeminfo|tasklist|sc|net|wmic|reg|certutil|bitsadmin|msiexec|mshta|cscript|wscript)"
SHELL_LINE = r"(?i)[\"'](?:cmd(?:\.exe)?|powershell(?:\.exe)?)[\"'].*[\"'](?:/c|/k|-c|-Command)"
SHELL_FILE = r"(?i)FileName\s*=\s*[\"'](?:cmd(?:\.exe)?|powershell(?:\.exe)?|/bin/(?:ba)?sh)[\"']"
FORMATTERS = r"(?:BinaryFormatter|NetDataContractSerializer|LosFormatter|ObjectStateFormatter|SoapFormatter)"

RULES = pack(
    "csharp",
    # Queries.
    R("cs-sql-tainted", SQL, r"(?:" + SQL_SINK + r").*(?:" + UNSAFE_TEXT + ")", "Query text with user data", "CRITICAL/HIGH", label="user", hit='new SqlCommand("SELECT a FROM t WHERE n=" + v{a});', miss='new SqlCommand("SELECT a FROM t WHERE n=@n");'),
    R("cs-sql-dynamic", SQL, r"(?:" + SQL_SINK + r").*(?i:" + SQL_WORD + r").*(?:\+|\{)", "Query assembled from parts", "HIGH/MEDIUM", absent=r"\.Parameters\s*\.\s*Add(?:WithValue)?\s*\(", absent_frame=(0, 15), hit='cmd.CommandText = "SELECT a FROM " + table;'),
    R("cs-sql-format", SQL, r"(?i)string\.Format\s*\(", "Query formatted with user data", "CRITICAL/HIGH", label="user", near=r"(?i)\b" + SQL_WORD + r"\b", near_frame=(-2, 1), hit='var q{a} = string.Format("SELECT {0} FROM t", v{a});'),
    R("cs-ef-interpolated", SQL, r"\.(?:FromSql(?:Raw)?|ExecuteSql(?:Raw|Command)?)\s*\(\s*\w+\s*[,)]", "Interpolated text as a raw query", "CRITICAL/HIGH", near=r"(?i)=\s*(?:\$@?\".*\b" + SQL_WORD + r"|.*\b" + SQL_WORD + r"\b.*[\"']\s*\+)", near_frame=(-9, 0), hit='var r{a} = $"SELECT a FROM {t}";\nctx.T.FromSqlRaw(r{a});'),
    R("cs-ef-raw", SQL, r"\.(?:FromSqlRaw|ExecuteSqlRaw|ExecuteSqlCommand|SqlQuery)\s*\(\s*(?:\$|[\"'].*[\"']\s*\+)", "Raw query with user data", "CRITICAL/HIGH", label="user", hit='ctx.T.FromSqlRaw("SELECT a FROM t WHERE n=" + v{a});'),
    R("cs-sql-stored", SQL, r"(?:" + SQL_SINK + r"|\.(?:FromSql(?:Raw)?|ExecuteSql(?:Raw|Command)?|SqlQuery)\s*\()", "Query with a stored value", "CRITICAL/HIGH", label="db", hit='cmd.CommandText = "SELECT a FROM t ORDER BY " + v{a};'),
    R("cs-sql-stored-text", SQL, r"(?i)\b(?:SELECT|UPDATE|DELETE|ORDER\s+BY|FROM)\b.*(?:[\"']\s*\+|\{)", "Query text with a stored value", "CRITICAL/HIGH", label="db", priority=-1, hit='var s{a} = "SELECT a FROM t ORDER BY " + v{a};'),
    # Commands.
    R("cs-arguments", CMD, r"\.?\bArguments\s*=", "Process arguments with user data", "CRITICAL/HIGH", label="user", hit='psi.Arguments = "/c " + v{a};', miss='psi.Arguments = "/c dir";'),
    R("cs-arguments-tool", CMD, r"(?i)\bArguments\s*=.*\b" + TOOLS + r"\b.*(?:[\"']\s*\+|\{)", "Tool arguments assembled from parts", "HIGH/MEDIUM", hit='psi.Arguments = "ping " + host;', miss='psi.Arguments = "ping localhost";'),
    R("cs-process", CMD, r"Process\.Start\s*\(|ProcessStartInfo", "Process with user data", "CRITICAL/HIGH", label="user", hit="Process.Start(v{a});", miss='Process.Start("notepad");'),
    R("cs-process-shell", CMD, r"Process\.Start\s*\(|ProcessStartInfo", "Shell with command flag", "CRITICAL/HIGH", label="user", plain="MEDIUM/MEDIUM", near=SHELL_LINE, near_frame=(-1, 3), hit='Process.Start("cmd.exe", "/c " + v{a});', miss='Process.Start("notepad.exe", v{a});'),
    R("cs-process-shell-concat", CMD, r"(?:Process\.Start\s*\(|ProcessStartInfo).*\+", "Shell command assembled from parts", "HIGH/HIGH", near=SHELL_LINE, near_frame=(-1, 3), hit='Process.Start("cmd.exe", "/c " + name);'),
    R("cs-psi-shell", CMD, r"new\s+ProcessStartInfo\s*\{", "Shell started from an initializer", "HIGH/HIGH", near=SHELL_FILE, near_frame=(0, 10), hit='var p{a} = new ProcessStartInfo {\n  FileName = "cmd.exe",\n  Arguments = "/c " + name\n};'),
    R("cs-invoke", CMD, r"\.InvokeMember\s*\(|MethodInfo.*\.Invoke\s*\(", "Process started by reflection", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", near=r"(?i)Process|Start|Shell|Command|Execute", near_frame=(-9, 1), hit='t.InvokeMember("Start", f, null, null, v{a});'),
    R("cs-destructor", CMD, r"Process\.Start\s*\(|\.Start\s*\(|(?i:cmd\.exe|powershell)", "Field of a constructor used in a finalizer", "CRITICAL/HIGH", label="user", near=r"~\w+\s*\(\s*\)", near_frame=(-8, 0), priority=1, hit="~D{a}() {\n  Process.Start(v{a});\n}"),
    R("cs-linq-select", CMD, r"\w\s*\.\s*Select\s*\(\s*\w+\s*=>.*(?:/c\s|cmd|powershell|-Command|-c\s).*(?:\{|\+)", "Query operator builds shell commands", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", hit='var l{a} = v{a}.Select(x => "/c " + x);'),
    R("cs-linq-first", CMD, r"\.(?:FirstOrDefault|First|Single|Last)\s*\(\s*\)", "Query result flows to a process", "HIGH/MEDIUM", label="user", near=r"Process\.Start|ProcessStartInfo", near_frame=(-4, 5), hit="var f{a} = v{a}.First();\nProcess.Start(f{a});"),
    R("cs-linq-aggregate", CMD, r"\.(?:Aggregate|Join|Concat)\s*\(", "Aggregated values flow to a process", "HIGH/MEDIUM", label="user", near=r"Process\.Start|Arguments\s*=|ProcessStartInfo", near_frame=(0, 10), hit="var g{a} = v{a}.Aggregate((x, y) => x + y);\nProcess.Start(g{a});"),
    R("cs-powershell", CMD, r"System\.Management\.Automation|PowerShell\.Create|\.Add(?:Script|Command)\s*\(", "Script with user data", "CRITICAL/HIGH", label="user", hit="ps.AddScript(v{a});"),
    R("cs-powershell-plain", CMD, r"\.Add(?:Script|Command)\s*\(", "Script executed", "HIGH/MEDIUM", hit='ps.AddScript("Get-Date");', miss="ps.AddParameter(x);"),
    # Deserialization.
    R("cs-formatter", DESER, FORMATTERS, "Formatter that builds any type", "CRITICAL/HIGH", hit="var b{a} = new BinaryFormatter();", miss="var b{a} = new Utf8Formatter();"),
    R("cs-json-typed", DESER, r"JsonConvert\.DeserializeObject", "Type names taken from data", "CRITICAL/HIGH", near=r"TypeNameHandling\s*[=.]\s*(?:TypeNameHandling\.)?(?:Auto|All|Objects|Arrays)", near_frame=(-9, 1), hit="s.TypeNameHandling = TypeNameHandling.All;\nvar o{a} = JsonConvert.DeserializeObject(body, s);"),
    R("cs-deserialize", DESER, r"\.Deserialize\s*\(|JsonConvert\.DeserializeObject|XmlSerializer|DataContractSerializer|JavaScriptSerializer", "User data deserialized", "HIGH/MEDIUM", label="user", hit="var d{a} = ser.Deserialize(v{a});", miss="var d{a} = ser.Serialize(v{a});"),
    R("cs-type-names", DESER, r"TypeNameHandling\s*=\s*(?:TypeNameHandling\.)?(?:Auto|All|Objects)", "Type names switched on", "HIGH/HIGH", hit="s.TypeNameHandling = TypeNameHandling.Auto;", miss="s.TypeNameHandling = TypeNameHandling.None;"),
    R("cs-viewstate-mac", DESER, r"(?i)EnableViewStateMac\s*=\s*[\"']?false", "View state is not authenticated", "CRITICAL/HIGH", hit="Page.EnableViewStateMac = false;", miss="Page.EnableViewStateMac = true;"),
    R("cs-viewstate-formatter", DESER, r"(?:LosFormatter|ObjectStateFormatter).*Deserialize|__VIEWSTATE.*Deserialize", "View state deserialized by hand", "CRITICAL/HIGH", priority=1, hit='var o{a} = new LosFormatter().Deserialize(Request.Form["__VIEWSTATE"]);'),
    R("cs-viewstate-encryption", AUTH, r"(?i)ViewStateEncryptionMode\s*[=.]\s*[\"']?(?:ViewStateEncryptionMode\.)?Never", "View state is not encrypted", "HIGH/HIGH", hit="Page.ViewStateEncryptionMode = ViewStateEncryptionMode.Never;"),
    R("cs-validate-request", AUTH, r"(?i)ValidateRequest\s*=\s*[\"']?false|\[ValidateInput\s*\(\s*false\s*\)\]", "Request validation is off", "MEDIUM/HIGH", hit="[ValidateInput(false)]", miss="[ValidateInput(true)]"),
    R("cs-viewstate-key", AUTH, r"(?i)ViewStateUserKey\s*=\s*(?:null|\"\")", "View state is not bound to a user", "MEDIUM/MEDIUM", hit="ViewStateUserKey = null;"),
    # Code.
    R("cs-compile", CODE, r"CSharpCodeProvider|CompileAssemblyFromSource|CSharpCompilation|SyntaxFactory", "Source compiled at run time", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", hit="provider.CompileAssemblyFromSource(v{a});"),
    R("cs-assembly", CODE, r"Assembly\.Load\s*\(\s*(?:byte|Convert\.FromBase64)", "Assembly loaded from bytes", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", hit="Assembly.Load(Convert.FromBase64String(v{a}));", miss='Assembly.Load("x");'),
    R("cs-expression", CODE, r"Expression\.(?:Lambda|Compile)|DynamicExpression", "Expression from user data", "HIGH/HIGH", label="user", hit="Expression.Lambda(v{a});"),
    R("cs-activator", CODE, r"Activator\.CreateInstance\s*\(|Type\.GetType\s*\(\s*\w", "Type name from user data", "CRITICAL/HIGH", label="user", hit="Activator.CreateInstance(v{a});", miss='Type.GetType("X");'),
    # XML, directories, templates.
    R("cs-xml-resolver", XXE, r"XmlResolver\s*=\s*new\s+XmlUrlResolver|DtdProcessing\s*=\s*DtdProcessing\.Parse|ProhibitDtd\s*=\s*false", "XML entities switched on", "CRITICAL/HIGH", hit="s.DtdProcessing = DtdProcessing.Parse;", miss="s.DtdProcessing = DtdProcessing.Prohibit;"),
    R("cs-xml-document", XXE, r"new\s+Xml(?:Document|TextReader)\s*\(", "XML read without protection", "HIGH/MEDIUM", absent=r"XmlResolver\s*=\s*null|DtdProcessing\.(?:Prohibit|Ignore)|ProhibitDtd\s*=\s*true", absent_frame=(0, 10), hit="var x{a} = new XmlDocument();"),
    R("cs-xml-tainted", XXE, r"\.LoadXml\s*\(|XmlReader\.Create\s*\(|XDocument\.(?:Load|Parse)\s*\(", "XML from user data", "HIGH/HIGH", label="user", absent=r"XmlResolver\s*=\s*null|DtdProcessing\.(?:Prohibit|Ignore)", absent_frame=(-5, 5), hit="doc.LoadXml(v{a});"),
    R("cs-xslt-trusted", XXE, r"XsltSettings\s*\(\s*true|XsltSettings\.TrustedXslt", "Trusted style sheets", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", hit="x.Load(v{a}, XsltSettings.TrustedXslt, r);", miss="x.Load(v{a}, XsltSettings.Default, r);"),
    R("cs-xslt", XXE, r"XslCompiledTransform", "Style sheet engine", "HIGH/MEDIUM", near=r"XmlUrlResolver|\.Load\s*\(", near_frame=(-3, 8), hit="var t{a} = new XslCompiledTransform();\nt{a}.Load(p);"),
    R("cs-url-resolver", XXE, r"XmlUrlResolver", "Resolver that follows addresses", "HIGH/MEDIUM", unless=r"XslCompiledTransform|XsltSettings", near=r"XmlDocument|XmlReader|LoadXml|XmlResolver\s*=", near_frame=(-5, 5), hit="doc.XmlResolver = new XmlUrlResolver();"),
    R("cs-machine-key", DESER, r"(?i)machineKey.*validation\s*=\s*[\"']?None", "Machine key validation is off", "CRITICAL/HIGH", hit='<machineKey validation="None" />'),
    R("cs-viewstate-user", AUTH, r"(?i)EnableViewState\s*=\s*(?:true|\"true\")", "View state without a user key", "MEDIUM/MEDIUM", absent=r"(?i)ViewStateUserKey\s*=", absent_frame=WHOLE, hit="EnableViewState = true;"),
    R("cs-type-from-request", DESER, r"Type\.GetType\s*\(\s*\w+\s*\)", "Type from user data reaches a decoder", "CRITICAL/HIGH", label="user", near=r"XmlSerializer|Deserialize|Activator\.CreateInstance|JsonConvert", near_frame=(0, 10), hit="var k{a} = Type.GetType(v{a});\nvar o{a} = new XmlSerializer(k{a});"),
    R("cs-ldap", LDAP, r"DirectorySearcher|\.Filter\s*=|DirectoryEntry\s*\(", "Directory filter with user data", "HIGH/HIGH", label="user", hit='s.Filter = "(u=" + v{a};', miss='s.Filter = "(u=x)";'),
    R("cs-xpath", XPATH, r"\.(?:SelectNodes|SelectSingleNode|XPathSelectElements?|XPathEvaluate|Evaluate|Compile)\s*\(", "XPath with user data", "CRITICAL/HIGH", label="user,db", hit='doc.SelectNodes("//u[" + v{a});', miss='doc.SelectNodes("//u");'),
    R("cs-xpath-dynamic", XPATH, r"\.(?:SelectNodes|SelectSingleNode|XPathSelectElements?|XPathEvaluate)\s*\(.*(?:\+|\$\")", "XPath assembled from parts", "HIGH/MEDIUM", hit='doc.SelectNodes("//u[" + name);'),
    R("cs-template", SSTI, r"Razor\.(?:Parse|Compile|RunCompile)\s*\(|Engine\.Razor|Template\.Parse\s*\(|RazorEngine", "Template text from user data", "CRITICAL/HIGH", label="user", hit="Razor.Parse(v{a});", miss='Razor.Parse("x");'),
)
