"""HTML, Vue and Svelte rules; none needs taint."""

from .model import DOMXSS, PROTO, REDIR, RXSS, Rule as R, pack

# Sinks, sources and names that raise confidence.
SOURCE = r"(?i)location\.(?:href|search|hash|pathname)|document\.(?:URL|documentURI|referrer|cookie)|window\.(?:name|location)|(?:localStorage|sessionStorage)\.getItem|\.value\b|\b(?:e|evt|event|message)\.data\b"
NAMES = r"\b(?:response|res|data|result|html|content|body|payload|input|text|msg|message|user|param|query|arg|val|value|href|url|link|uri|path|src)\b"
SAFE = r"(?i)sanitize|encode|escape|dompurify"
DOM = r"\.(?:innerHTML|outerHTML)\s*=|document\.write(?:ln)?\s*\(|\beval\s*\(|\bnew\s+Function\s*\(|\.insertAdjacentHTML\s*\(|\$\([^)]*\)\.html\s*\(\s*[^)]|dangerouslySetInnerHTML|v-html\s*="
NAVIGATE = r"location\.(?:href|assign|replace)\s*=\s*[^\"'\s]|\bwindow\.open\s*\(\s*[^\"'\s]"

RULES = pack(
    "markup",
    R("ml-dom", DOMXSS, r"(?i)" + DOM, "Markup sink in a page", "CRITICAL/MEDIUM", unless=SAFE, hit="<script>el.innerHTML = x;</script>", miss="<script>el.innerHTML = sanitize(x);</script>"),
    R("ml-dom-source", DOMXSS, r"(?i)(?:" + DOM + r").*(?:" + SOURCE[4:] + "|" + NAMES + ")", "Markup sink fed by a source", "CRITICAL/HIGH", unless=SAFE, hit="<script>document.write(location.hash)</script>"),
    R("ml-selector", DOMXSS, r"(?i)\$\s*\([^)]*\+[^)]*location\.", "Selector built from the address", "MEDIUM/HIGH", unless=SAFE, hit="<script>$('#' + location.hash)</script>"),
    R("ml-navigate", REDIR, r"(?i)" + NAVIGATE, "Navigation sink in a page", "HIGH/MEDIUM", unless=SAFE, hit="<script>location.href = x;</script>", miss="<script>location.href = '/x';</script>"),
    R("ml-proto", PROTO, r"\[\s*['\"]__proto__['\"]\s*\]|\.__proto__\b|\.constructor\.prototype\b", "Prototype reached by name", "CRITICAL/HIGH", absent=r"hasOwnProperty", absent_frame=(-4, 2), hit="<script>o.__proto__.x = 1</script>"),
    R("ml-template-raw", RXSS, r"\{\{\{\s*\w+\s*\}\}\}|<%-\s*\w+\s*%>", "Unescaped template value", "CRITICAL/HIGH", hit="<p>{{{ name }}}</p>", miss="<p>{{ name }}</p>"),
    R("ml-javascript-url", RXSS, r"(?i)href\s*=\s*['\"]?\s*javascript:|on\w+\s*=\s*['\"][^\"']*\{\{", "Script in an attribute", "HIGH/HIGH", hit='<a href="javascript:run()">x</a>', miss='<a href="/x">x</a>'),
)
