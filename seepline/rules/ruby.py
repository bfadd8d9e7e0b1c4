"""Ruby rules."""

from .model import CMD, CODE, DESER, SQL, SSTI, Rule as R, pack

# Query methods and process calls.
QUERY = r"\.(?:where|select|joins|order)\s*\([\"']|\.find_by_sql\s*\(|\.execute\s*\("
COMMAND = r"\bsystem\s*\(|\bexec\s*\(|`[^`]+`|%x[{\[]|IO\.popen\s*\(|Open3\.|Kernel\.(?:system|exec)"

RULES = pack(
    "ruby",
    R("rb-query", SQL, QUERY, "Query with user data", "CRITICAL/HIGH", label="user", hit='User.where("n = " + v{a})', miss='User.where("n = ?", 1)'),
    R("rb-query-interpolated", SQL, r"(?:" + QUERY + r").*#\{", "Query interpolated", "HIGH/MEDIUM", hit='User.where("n = #{name}")', miss='User.where("n = 1")'),
    R("rb-arel", SQL, r"Arel\.sql\s*\(", "Raw fragment with user data", "CRITICAL/HIGH", label="user", hit="User.order(Arel.sql(v{a}))", miss='User.order(Arel.sql("n"))'),
    R("rb-arel-interpolated", SQL, r"Arel\.sql\s*\(.*#\{", "Raw fragment interpolated", "CRITICAL/HIGH", hit='User.order(Arel.sql("#{col} asc"))'),
    R("rb-arel-direction", SQL, r"Arel\.sql\s*\(.*(?:sort_key|sort_column|column|field|order_by)", "Only the sort direction is checked", "HIGH/HIGH", near=r"(?:asc|desc|ASC|DESC)[\"'\]]", near_frame=(-5, 0), absent=r"ALLOWED|VALID|SAFE|PERMITTED|include\?", absent_frame=(-5, 0), hit="dir{a} = %w['asc', 'desc']\nUser.order(Arel.sql(sort_key))"),
    R("rb-structure-db", SQL, r"\.(?:order|reorder|group)\s*\(", "Stored value in query structure", "CRITICAL/HIGH", label="db", hit="User.order(v{a})", miss="User.order(:name)"),
    R("rb-calculation-db", SQL, r"\.(?:sum|count|average|minimum|maximum|calculate|pluck)\s*\(", "Stored value in a calculation", "CRITICAL/HIGH", label="db", hit="User.sum(v{a})", miss="User.sum(:age)"),
    R("rb-destructive-db", SQL, r"\.(?:delete_all|destroy_all|update_all)\s*\(", "Stored value in a changing query", "CRITICAL/HIGH", label="db", hit="User.delete_all(v{a})", miss="User.delete_all(id: 1)"),
    R("rb-destructive", SQL, r"\.(?:delete_all|destroy_all|update_all)\s*\(.*#\{", "Changing query interpolated", "HIGH/MEDIUM", hit='User.update_all("n = #{name}")'),
    R("rb-command", CMD, COMMAND, "Command with user data", "CRITICAL/HIGH", label="user", hit='system("ls " + v{a})', miss='system("ls")'),
    R("rb-command-interpolated", CMD, r"(?:" + COMMAND + r").*#\{|`[^`]*#\{", "Command interpolated", "CRITICAL/HIGH", hit='system("ls #{dir}")', miss='system("ls")'),
    R("rb-command-shell", CMD, r"\b(?:system|exec)\b|IO\.popen|Open3\.", "Shell with command flag", "CRITICAL/HIGH", label="user", plain="HIGH/HIGH", near=r"[\"'](?:/bin/sh|/bin/bash|sh|bash)[\"'].*[\"']-c[\"']", near_frame=(0, 3), hit='Open3.capture3("sh", "-c", v{a})'),
    R("rb-send-dangerous", CODE, r"\.send\s*\([^)]*(?:system|exec|eval)", "Dangerous method sent by name", "HIGH/HIGH", hit="obj.send(:eval, x)", miss="obj.send(:name)"),
    R("rb-eval", CODE, r"\beval\s*\(", "Data evaluated as code", "CRITICAL/HIGH", label="user", hit="eval(v{a})", miss='eval("1")'),
    R("rb-constantize", CODE, r"\.(?:safe_)?constantize\b", "Class name from user data", "CRITICAL/HIGH", label="user", hit="k{a} = v{a}.constantize", miss='k{a} = "User".constantize'),
    R("rb-send", CODE, r"\.(?:public_)?send\s*\(", "Method name from user data", "HIGH/MEDIUM", label="user", hit="obj.public_send(v{a})", miss="obj.public_send(:name)"),
    R("rb-try", CODE, r"\.try\s*\(\s*params\s*\[", "Method name from the request", "HIGH/HIGH", hit="obj.try(params[:m])", miss="obj.try(:name)"),
    R("rb-load", DESER, r"Marshal\.load\s*\(|YAML\.load\s*\(", "Objects revived from data", "CRITICAL/HIGH", label="user", plain="HIGH/MEDIUM", hit="Marshal.load(v{a})", miss="YAML.safe_load(v{a})"),
    R("rb-erb", SSTI, r"ERB\.new\s*\(|render\s+inline:", "Template text from user data", "CRITICAL/HIGH", label="user", hit="ERB.new(v{a})", miss='ERB.new("x")'),
)
