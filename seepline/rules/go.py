"""Go rules."""

from .model import CMD, CODE, DESER, LDAP, NOSQL, REDIR, SQL, SSTI, WHOLE, XSS, Rule as R, pack

# Driver, query and collection methods.
QUERY = r"\.(?:Query|QueryContext|QueryRow|QueryRowContext|Exec|ExecContext|Prepare|PrepareContext|Queryx|QueryRowx|NamedQuery|NamedExec|Raw)\s*\("
BOUND = r"\"[^\"]*(?:\?|\$[0-9]|:\w)[^\"]*\"\s*,|`[^`]*(?:\?|\$[0-9]|:\w)[^`]*`\s*,"
SHELL = r"[\"](?:/bin/)?(?:bash|sh)[\"]\s*,\s*\"-c\"|\"cmd(?:\.exe)?\"\s*,\s*\"/[cC]\""
MONGO = r"(?i:\b\w*(?:collection|coll|mongo)\w*|\bcol)\.(?:Find|FindOne|FindOneAndUpdate|FindOneAndDelete|FindOneAndReplace|UpdateOne|UpdateMany|DeleteOne|DeleteMany|ReplaceOne|Aggregate|CountDocuments|Distinct|InsertOne|InsertMany)\s*\("
ENCODED = r"html\.EscapeString|template\.HTMLEscapeString|url\.QueryEscape"

RULES = pack(
    "go",
    R("go-sql", SQL, QUERY, "Query with user data", "CRITICAL/HIGH", label="user", unless=BOUND + r"|(?i:\b\w*stmt\w*|prepared\w*)\.|\bhttp\.|\b[rc]\.URL\.Query\(\)|\bc\.Query\(", hit='db.Query("SELECT a FROM t WHERE n=" + v{a})', miss='db.Query("SELECT a FROM t WHERE n=?", v{a})'),
    R("go-sql-sprintf", SQL, r"(?i)fmt\.Sprintf\s*\(\s*[\"`][^\"`]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^\"`]*%", "Query formatted with user data", "CRITICAL/HIGH", label="user", hit='q{a} := fmt.Sprintf("SELECT a FROM t WHERE n=%s", v{a})', miss='q{a} := fmt.Sprintf("hello %s", v{a})'),
    R("go-sql-concat", SQL, r"(?i)[\"`][^\"`]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^\"`]*[\"`]\s*\+", "Query concatenated with user data", "CRITICAL/HIGH", label="user", hit='q{a} := "SELECT a FROM t WHERE n=" + v{a}', miss='q{a} := "SELECT a FROM t"'),
    R("go-gorm", SQL, r"\.(?:Where|Having|Joins|Order|Group|Select)\s*\(", "Query fragment with user data", "HIGH/HIGH", label="user", unless=BOUND + r"|\.\w+\s*\(\s*(?:&|map\[|\w+\{)", hit='db.Where("n = " + v{a})', miss='db.Where("n = ?", v{a})'),
    R("go-sql-stored", SQL, QUERY, "Query with a stored value", "HIGH/MEDIUM", label="db", unless=BOUND, hit='db.Exec("DELETE FROM t WHERE n=" + v{a})', miss='db.Exec("DELETE FROM t WHERE n=?", v{a})'),
    R("go-shell", CMD, SHELL, "Shell with command flag", "CRITICAL/HIGH", label="user", hit='exec.Command("sh", "-c", v{a})', miss='exec.Command("ls", v{a})'),
    R("go-command", CMD, r"\bexec\.Command(?:Context)?\s*\(\s*(?:ctx\s*,\s*)?[^\"`\s]", "Program name from user data", "CRITICAL/HIGH", label="user", hit="exec.Command(v{a})", miss='exec.Command("ls", v{a})'),
    R("go-start-process", CMD, r"\b(?:os\.StartProcess|syscall\.Exec|syscall\.ForkExec)\s*\(", "Process from user data", "CRITICAL/HIGH", label="user", hit="os.StartProcess(v{a}, nil, attr)", miss='os.StartProcess("/bin/ls", nil, attr)'),
    R("go-template", SSTI, r"template\.New\s*\(.*\)\.Parse\s*\(|\bt(?:mpl|emplate)?\w*\.Parse\s*\(", "Template text from user data", "HIGH/HIGH", label="user", unless=r"ParseFiles|ParseGlob", hit='template.New("x").Parse(v{a})', miss='template.New("x").ParseFiles(v{a})'),
    R("go-template-raw", XSS, r"\btemplate\.(?:HTML|JS|URL|CSS|HTMLAttr)\s*\(", "User data marked as safe markup", "HIGH/HIGH", label="user", unless=ENCODED, hit="out{a} := template.HTML(v{a})", miss='out{a} := template.HTML("<b>")'),
    R("go-text-template", XSS, r"text/template", "Text templates used for pages", "HIGH/HIGH", near=r"http\.ResponseWriter|\.Execute\s*\(\s*w\b", near_frame=WHOLE, hit='import "text/template"\nt{a}.Execute(w, d)', miss='import "html/template"'),
    R("go-mongo", NOSQL, MONGO, "Query document with user data", "CRITICAL/HIGH", label="user", unless=r"bson\.[MD]\{\s*\{?\s*\"\w+\"\s*[:,]\s*\"[^\"]*\"", hit='collection.FindOne(ctx, bson.M{"n": v{a}})', miss='collection.FindOne(ctx, bson.M{"n": "x"})'),
    R("go-fprint", XSS, r"\bfmt\.Fprint(?:f|ln)?\s*\(\s*(?:[wW]\b|\w*[rR]esponse[wW]riter)", "Response with user data", "HIGH/HIGH", label="user", unless=ENCODED, hit='fmt.Fprintf(w, "<p>%s", v{a})', miss='fmt.Fprintf(w, "ok")'),
    R("go-write", XSS, r"\b(?:[wW]|\w*[rR]esponse[wW]riter)\.Write(?:String)?\s*\(|\bio\.WriteString\s*\(\s*[wW]\b", "Response with user data", "HIGH/HIGH", label="user", unless=ENCODED, hit="w.Write([]byte(v{a}))", miss='w.Write([]byte("ok"))'),
    R("go-framework-html", XSS, r"\bc\.(?:HTML|HTMLBlob|Data|String|SendString|Send)\s*\(", "Response with user data", "HIGH/HIGH", label="user", unless=ENCODED, hit="c.HTML(200, v{a})", miss='c.HTML(200, "ok")'),
    R("go-redirect", REDIR, r"\bhttp\.Redirect\s*\(|\bc\.Redirect\s*\(", "Redirect from user data", "MEDIUM/HIGH", label="user", hit="http.Redirect(w, r, v{a}, 302)", miss='http.Redirect(w, r, "/x", 302)'),
    R("go-ldap-request", LDAP, r"ldap\.NewSearchRequest\s*\(", "Directory filter with user data", "HIGH/HIGH", label="user", unless=r"ldap\.EscapeFilter", hit="ldap.NewSearchRequest(base, v{a})", miss='ldap.NewSearchRequest(base, "(u=x)")'),
    R("go-ldap-format", LDAP, r"fmt\.Sprintf\s*\(\s*[\"`][^\"`]*(?:uid|cn|sn|mail|dn|sAMAccountName|objectClass)\s*=\s*%", "Directory filter formatted with user data", "HIGH/MEDIUM", label="user", unless=r"ldap\.EscapeFilter", hit='f{a} := fmt.Sprintf("(uid=%s)", v{a})', miss='f{a} := fmt.Sprintf("(uid=%s)", ldap.EscapeFilter(v{a}))'),
    R("go-gob", DESER, r"\bgob\.NewDecoder\s*\(", "Objects decoded from user data", "HIGH/HIGH", label="user", hit="gob.NewDecoder(v{a})", miss="gob.NewEncoder(v{a})"),
    R("go-yaml", DESER, r"\byaml\.(?:Unmarshal|NewDecoder)\s*\(", "YAML from user data", "HIGH/HIGH", label="user", hit="yaml.Unmarshal(v{a}, cfg)", miss="yaml.Marshal(cfg)"),
    R("go-xml", DESER, r"\bxml\.(?:Unmarshal|NewDecoder)\s*\(", "XML from user data", "MEDIUM/MEDIUM", label="user", hit="xml.Unmarshal(v{a}, cfg)", miss="xml.Marshal(cfg)"),
    R("go-reflect", CODE, r"\.MethodByName\s*\(", "Method name from user data", "HIGH/HIGH", label="user", hit="reflect.ValueOf(o).MethodByName(v{a})", miss='reflect.ValueOf(o).MethodByName("X")'),
    R("go-plugin", CODE, r"\bplugin\.Open\s*\(", "Plugin path from user data", "CRITICAL/HIGH", label="user", hit="plugin.Open(v{a})", miss='plugin.Open("x.so")'),
)
