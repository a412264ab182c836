"""Rule data: security, quality and leak rules.

Ids, names, categories and severities are fixed values; patterns are written for
java.util.regex over single lines.
"""

from __future__ import annotations

from lodestrata.operators.rules import Rule

_SECRET = r"(?i)(password|passwd|pwd|secret|token|api_?key|private_?key|credential)"
_REQUEST = r"(?i)(request|req|params|query|input|argv|body|form)\b"


def _r(rule_id: str, name: str, category: str, severity: str, cwe: str, pattern: str, **more) -> Rule:
    language = rule_id.split(".")[0]
    languages = {"javascript": ("ts",), "universal": ()}.get(language, (language,))
    return Rule(rule_id, name, category, severity, pattern, languages, cwe=cwe, **more)


SECURITY = (
    _r("c.gets_call", "Use of gets()", "memory_corruption", "HIGH", "242", r"\bgets\s*\("),
    _r("c.unsafe_string_copy", "Unbounded String Copy", "memory_corruption", "HIGH", "120", r"\b(strcpy|strcat|sprintf|vsprintf)\s*\("),
    _r("c.format_string", "Uncontrolled Format String", "memory_corruption", "HIGH", "134", r"\b(printf|syslog)\s*\(\s*[A-Za-z_]\w*\s*\)"),
    _r("c.command_injection", "OS Command Injection", "io_validation", "HIGH", "78", r"\b(system|popen|execl?p?)\s*\(\s*[A-Za-z_]"),
    _r("c.weak_random", "Weak Randomness for Security-Sensitive Value", "cryptography", "MEDIUM", "338", r"\bs?rand\s*\(", shape="both", pattern2=_SECRET),
    _r("c.insecure_temp_file", "Insecure Temporary File Creation", "unsafe_deprecated", "MEDIUM", "377", r"\b(mktemp|tmpnam|tempnam)\s*\("),
    _r("cpp.unsafe_string_copy", "Unbounded String Copy", "memory_corruption", "HIGH", "120", r"\b(strcpy|strcat|sprintf)\s*\("),
    _r("cpp.reinterpret_cast", "Unsafe Type Reinterpretation (reinterpret_cast)", "memory_corruption", "MEDIUM", "704", r"\breinterpret_cast\s*<"),
    _r("cpp.raw_new_delete", "Manual Memory Management (raw new)", "memory_corruption", "LOW", "401", r"=\s*new\s+\w+", shape="without", pattern2=r"(unique|shared)_ptr|make_"),
    _r("go.weak_crypto", "Weak Cryptography", "cryptography", "HIGH", "327", r"\b(md5|sha1|des|rc4)\.(New|Sum|NewCipher)\w*\("),
    _r("go.insecure_tls", "Disabled TLS Verification", "network_security", "HIGH", "295", r"InsecureSkipVerify\s*:\s*true"),
    _r("go.command_injection", "Command Injection Risk", "io_validation", "HIGH", "78", r"exec\.Command(Context)?\([^)]*\+|exec\.Command\(\s*\"\"\s*,\s*\"\"\s*,\s*[a-z]"),
    _r("go.http_server_no_tls", "HTTP Server Without TLS", "network_security", "MEDIUM", "319", r"http\.ListenAndServe\("),
    _r("go.sql_fmt_sprintf", "SQL Query via fmt.Sprintf", "injection", "HIGH", "89", r"(?i)Sprintf\([^)]*(select|insert into|update|delete from)\b", text="raw"),
    _r("go.insecure_rand", "Insecure Random in Security Context", "cryptography", "MEDIUM", "338", r"\brand\.(Int|Intn|Read|Float64)\w*\(", shape="both", pattern2=_SECRET),
    _r("go.tls_no_minversion", "TLS Config Missing MinVersion", "network_security", "MEDIUM", "326", r"tls\.Config\{", shape="guarded", pattern2=r"MinVersion"),
    _r("go.cookie_no_httponly", "Cookie Missing HttpOnly Flag", "session_mgmt", "MEDIUM", "1004", r"http\.Cookie\{", shape="guarded", pattern2=r"HttpOnly\s*:\s*true"),
    _r("go.cookie_no_secure", "Cookie Missing Secure Flag", "session_mgmt", "MEDIUM", "614", r"http\.Cookie\{", shape="guarded", pattern2=r"\bSecure\s*:\s*true"),
    _r("go.cookie_no_samesite", "Cookie Missing SameSite Attribute", "session_mgmt", "LOW", "1275", r"http\.Cookie\{", shape="guarded", pattern2=r"SameSite"),
    _r("go.path_traversal", "Path Traversal", "io_validation", "HIGH", "22", r"(os\.(Open|ReadFile|Create)|filepath\.Join)\(", shape="both", pattern2=_REQUEST),
    _r("go.sensitive_logging", "Sensitive Data in Logs", "data_exposure", "MEDIUM", "532", r"\b(log|logger|slog|fmt)\.(Print|Info|Debug|Error|Warn)\w*\(", shape="both", pattern2=_SECRET),
    _r("go.gob_deserialization", "Unsafe gob Deserialization", "unsafe_exec", "MEDIUM", "502", r"gob\.NewDecoder\("),
    _r("go.ssrf", "Server-Side Request Forgery", "network_security", "HIGH", "918", r"http\.(Get|Post|Head)\(", shape="both", pattern2=_REQUEST),
    _r("go.insecure_file_permissions", "Broad File Permissions", "platform_config", "MEDIUM", "732", r"os\.(WriteFile|OpenFile|Chmod|MkdirAll?)\([^)]*0o?7?(666|777|776)\b"),
    _r("go.fast_hash_for_password", "Fast Hash Used for Password", "cryptography", "HIGH", "916", r"\bsha(1|256|512)\.(Sum\w*|New)\(", shape="both", pattern2=r"(?i)passw"),
    _r("go.jwt_no_method_check", "JWT Parsed Without Signing-Method Validation", "authentication", "HIGH", "347", r"jwt\.Parse(WithClaims)?\(", shape="guarded", pattern2=r"SigningMethod|WithValidMethods"),
    _r("go.zip_slip", "Zip-Slip / Archive Path Traversal", "unsafe_exec", "HIGH", "22", r"(zip\.OpenReader|tar\.NewReader)\(", shape="guarded", pattern2=r"HasPrefix|filepath\.IsLocal|\.\.\""),
    _r("go.log_injection", "Log Injection", "io_validation", "LOW", "117", r"\blog\.Print\w*\(", shape="both", pattern2=r"\br\.(URL|Form|Header)"),
    _r("go.toctou", "TOCTOU Race Condition", "io_validation", "LOW", "367", r"os\.Stat\(", shape="paired", pattern2=r"os\.(Open|Create|Remove|Rename)\("),
    _r("go.open_redirect", "Open Redirect", "session_mgmt", "MEDIUM", "601", r"http\.Redirect\(", shape="both", pattern2=_REQUEST),
    _r("go.body_no_size_limit", "Request Body Read Without Size Limit", "io_validation", "LOW", "770", r"io\.ReadAll\(\s*\w+\.Body", shape="guarded", pattern2=r"MaxBytesReader|LimitReader"),
    _r("go.unrestricted_file_upload", "Unrestricted File Upload", "io_validation", "MEDIUM", "434", r"\.FormFile\(", shape="guarded", pattern2=r"DetectContentType|filepath\.Ext"),
    _r("java.sql_concat", "SQL Injection via Concatenation", "injection", "HIGH", "89", r"(?i)(executeQuery|executeUpdate|prepareStatement|createQuery)\([^)]*\+"),
    _r("java.command_injection", "Command Injection Risk", "io_validation", "HIGH", "78", r"Runtime\.getRuntime\(\)\.exec\(|new ProcessBuilder\([^)]*\+"),
    _r("java.insecure_deserialization", "Insecure Deserialization", "unsafe_exec", "HIGH", "502", r"new ObjectInputStream\(|\.readObject\(\)"),
    _r("java.xxe", "XML External Entity (XXE)", "unsafe_exec", "HIGH", "611", r"(DocumentBuilderFactory|SAXParserFactory|XMLInputFactory)\.new(Instance|Factory)\(", shape="guarded", pattern2=r"disallow-doctype-decl|FEATURE_SECURE_PROCESSING|SUPPORT_DTD"),
    _r("java.zip_slip", "Zip-Slip / Archive Path Traversal", "unsafe_exec", "HIGH", "22", r"new Zip(InputStream|File)\(", shape="guarded", pattern2=r"normalize\(\)|getCanonicalPath|startsWith"),
    _r("java.weak_crypto", "Weak Cryptography", "cryptography", "HIGH", "327", r"getInstance\(\s*\"(MD5|SHA-?1|DES|RC4|DESede)", text="raw"),
    _r("java.insecure_random", "Insecure Random in Security Context", "cryptography", "MEDIUM", "338", r"new Random\(|Math\.random\(", shape="both", pattern2=_SECRET),
    _r("java.trust_all_certs", "TLS Certificate Verification Disabled", "network_security", "HIGH", "295", r"checkServerTrusted\([^)]*\)\s*(throws \w+\s*)?\{\s*\}"),
    _r("java.trust_all_hosts", "Hostname Verification Disabled", "network_security", "HIGH", "297", r"NoopHostnameVerifier|ALLOW_ALL_HOSTNAME|setHostnameVerifier\(\s*\([^)]*\)\s*->\s*true"),
    _r("java.spring_csrf_disabled", "Spring Security CSRF Protection Disabled", "session_mgmt", "MEDIUM", "352", r"csrf\(\)\.disable\(|csrf\(\w+\s*->\s*\w+\.disable"),
    _r("java.path_traversal", "Path Traversal", "io_validation", "HIGH", "22", r"new File(InputStream|Reader)?\(|Paths\.get\(", shape="both", pattern2=r"getParameter|getHeader|@PathVariable"),
    _r("java.xss", "Reflected XSS", "injection", "HIGH", "79", r"getWriter\(\)\.(print|write)\w*\(", shape="both", pattern2=r"getParameter"),
    _r("java.ssrf", "Server-Side Request Forgery", "network_security", "HIGH", "918", r"new URL\(|RestTemplate|HttpRequest\.newBuilder", shape="both", pattern2=r"getParameter|request\."),
    _r("java.open_redirect", "Open Redirect", "session_mgmt", "MEDIUM", "601", r"sendRedirect\(", shape="both", pattern2=r"getParameter|request\."),
    _r("java.sensitive_logging", "Sensitive Data in Logs", "data_exposure", "MEDIUM", "532", r"(?i)\blog(ger)?\.(info|debug|warn|error|trace)\(", shape="both", pattern2=_SECRET),
    _r("java.verbose_error", "Stack Trace Exposed to Client", "data_exposure", "LOW", "209", r"\.printStackTrace\("),
    _r("kotlin.weak_crypto", "Weak Cryptography", "cryptography", "HIGH", "327", r"getInstance\(\s*\"(MD5|SHA-?1|DES)", text="raw"),
    _r("kotlin.ecb_cipher", "ECB Cipher Mode", "cryptography", "HIGH", "327", r"/ECB/", text="raw"),
    _r("kotlin.command_injection", "Command Injection Risk", "io_validation", "HIGH", "78", r"Runtime\.getRuntime\(\)\.exec\("),
    _r("kotlin.javascript_enabled", "JavaScript Enabled in WebView", "platform_config", "MEDIUM", "749", r"javaScriptEnabled\s*=\s*true"),
    _r("kotlin.world_readable_file", "World-Readable / World-Writable File Mode", "data_exposure", "HIGH", "732", r"MODE_WORLD_(READABLE|WRITEABLE)"),
    _r("python.eval_exec", "Dynamic Code Execution", "unsafe_exec", "HIGH", "95", r"(?<![.\w])(eval|exec)\s*\("),
    _r("python.insecure_deserialization", "Insecure Deserialization", "unsafe_exec", "HIGH", "502", r"\b(c?[pP]ickle|dill|jsonpickle)\.(loads?|decode)\("),
    _r("python.unsafe_yaml", "Unsafe YAML Load", "unsafe_exec", "HIGH", "502", r"yaml\.load\(", shape="without", pattern2=r"SafeLoader"),
    _r("python.shell_injection", "Shell Injection Risk", "io_validation", "HIGH", "78", r"subprocess\.\w+\([^)]*shell\s*=\s*True"),
    _r("python.weak_crypto", "Weak Cryptography", "cryptography", "HIGH", "327", r"hashlib\.(md5|sha1)\("),
    _r("python.os_system", "Shell Command via os.system", "io_validation", "HIGH", "78", r"\bos\.(system|popen)\("),
    _r("python.debug_mode", "Debug Mode Enabled", "platform_config", "MEDIUM", "489", r"\bDEBUG\s*=\s*True|debug\s*=\s*True"),
    _r("python.unverified_ssl", "SSL Certificate Verification Disabled", "network_security", "HIGH", "295", r"verify\s*=\s*False|_create_unverified_context"),
    _r("python.path_traversal", "Path Traversal", "io_validation", "HIGH", "22", r"\bopen\(|send_file\(", shape="both", pattern2=r"request\.(args|form|values|GET|POST)"),
    _r("python.sql_concat", "SQL Injection via Concatenation", "injection", "HIGH", "89", r"\.execute\(\s*[^)]*(\+|%\s*\()"),
    _r("python.sql_fstring", "SQL Built with an f-string", "injection", "HIGH", "89", r"(?i)\.execute\(\s*f[\"'].*(select|insert|update|delete)", text="raw"),
    _r("python.weak_random", "Weak Random for Security Context", "cryptography", "MEDIUM", "338", r"\brandom\.(random|randint|choice|getrandbits)\(", shape="both", pattern2=_SECRET),
    _r("python.sensitive_logging", "Sensitive Data in Logs", "data_exposure", "MEDIUM", "532", r"\b(log|logger|logging)\.\w+\(|\bprint\(", shape="both", pattern2=_SECRET),
    _r("python.xxe", "XML External Entity (XXE)", "unsafe_exec", "HIGH", "611", r"\b(etree|minidom|sax)\.(parse|fromstring|parseString)\(", shape="guarded", pattern2=r"defusedxml|resolve_entities\s*=\s*False"),
    _r("python.ssrf", "Server-Side Request Forgery", "network_security", "HIGH", "918", r"\brequests\.(get|post|put|head)\(", shape="both", pattern2=r"request\.(args|form|values|GET|POST)"),
    _r("python.jwt_alg_none", "JWT Algorithm None", "authentication", "HIGH", "347", r"(?i)algorithms?\s*=\s*\[?\s*[\"']none", text="raw"),
    _r("python.jwt_no_algorithms", "JWT decode Without algorithms Allowlist", "authentication", "HIGH", "347", r"\bjwt\.decode\(", shape="without", pattern2=r"algorithms"),
    _r("python.ssti", "Server-Side Template Injection", "injection", "HIGH", "1336", r"render_template_string\("),
    _r("python.insecure_file_permissions", "Broad File Permissions", "platform_config", "MEDIUM", "732", r"os\.chmod\([^)]*0o?(666|777)"),
    _r("python.fast_hash_for_password", "Fast Hash Used for Password", "cryptography", "HIGH", "916", r"hashlib\.sha(1|256|512)\(", shape="both", pattern2=r"(?i)passw"),
    _r("python.zip_slip", "Zip-Slip / Archive Path Traversal", "unsafe_exec", "HIGH", "22", r"\.extractall\("),
    _r("python.toctou", "TOCTOU Race Condition", "io_validation", "LOW", "367", r"os\.path\.exists\(", shape="paired", pattern2=r"\bopen\(|os\.remove\("),
    _r("python.assert_used", "Assert Used for Control Flow", "crash_factors", "LOW", "617", r"^\s*assert\b", skip_tests=True),
    _r("python.bind_all_interfaces", "Binds to All Network Interfaces", "network_security", "MEDIUM", "605", r"[\"']0\.0\.0\.0[\"']", text="raw"),
    _r("python.hardcoded_tmp", "Hardcoded Temporary Directory", "unsafe_deprecated", "LOW", "377", r"[\"']/tmp/", text="raw"),
    _r("python.tempfile_mktemp", "Insecure tempfile.mktemp", "unsafe_deprecated", "MEDIUM", "377", r"tempfile\.mktemp\("),
    _r("python.jinja2_autoescape_off", "Jinja2 Autoescape Disabled", "injection", "HIGH", "79", r"autoescape\s*=\s*False"),
    _r("python.paramiko_autoadd", "SSH Host Keys Auto-Accepted", "network_security", "HIGH", "295", r"AutoAddPolicy"),
    _r("python.telnet_ftp", "Cleartext Telnet / FTP", "network_security", "MEDIUM", "319", r"\b(telnetlib|ftplib)\."),
    _r("python.marshal_shelve", "Unsafe marshal / shelve", "unsafe_exec", "MEDIUM", "502", r"\b(marshal\.loads?|shelve\.open)\("),
    _r("python.weak_hash_new", "Weak Hash via hashlib.new", "cryptography", "HIGH", "327", r"hashlib\.new\(\s*[\"'](md5|sha1)", text="raw"),
    _r("python.cors_wildcard", "CORS Allows Any Origin", "session_mgmt", "MEDIUM", "942", r"(?i)(allow_origins|CORS_ORIGINS?)\s*=\s*\[?\s*[\"']\*", text="raw"),
    _r("python.requests_no_timeout", "HTTP Request Without Timeout", "network_security", "LOW", "400", r"\brequests\.(get|post|put|delete)\([^)]*\)", shape="without", pattern2=r"timeout"),
    _r("python.django_mark_safe", "Django mark_safe", "injection", "MEDIUM", "79", r"\bmark_safe\("),
    _r("python.django_csrf_exempt", "Django CSRF Protection Disabled", "session_mgmt", "MEDIUM", "352", r"@csrf_exempt"),
    _r("python.django_allowed_hosts_wildcard", "Django ALLOWED_HOSTS Wildcard", "platform_config", "MEDIUM", "183", r"ALLOWED_HOSTS\s*=\s*\[\s*[\"']\*", text="raw"),
    _r("python.celery_pickle", "Celery Accepts pickle", "unsafe_exec", "HIGH", "502", r"accept_content\s*=.*pickle", text="raw"),
    _r("rust.unsafe_block", "Unsafe Block", "memory_corruption", "MEDIUM", "119", r"\bunsafe\s*\{"),
    _r("rust.transmute", "Unsafe Memory Reinterpretation (transmute)", "memory_corruption", "HIGH", "704", r"\btransmute\s*(::<|\()"),
    _r("rust.unwrap_panic", "Panic on Error (.unwrap / .expect)", "crash_factors", "LOW", "248", r"\.(unwrap\(\)|expect\()", skip_tests=True),
    _r("rust.from_utf8_unchecked", "Unchecked UTF-8 Conversion", "memory_corruption", "MEDIUM", "176", r"from_utf8_unchecked"),
    _r("rust.sql_injection", "Potential SQL Injection", "injection", "HIGH", "89", r"(?i)format!\(\s*\"[^\"]*(select|insert|update|delete)\b", text="raw"),
    _r("rust.insecure_tls", "Insecure TLS Configuration", "network_security", "HIGH", "295", r"danger_accept_invalid_(certs|hostnames)\(\s*true"),
    _r("rust.env_set_var", "Dynamic Environment Variable Mutation (set_var)", "platform_config", "LOW", "454", r"env::set_var\("),
    _r("rust.panic_macro", "Explicit panic!()", "crash_factors", "LOW", "248", r"\bpanic!\(", skip_tests=True),
    _r("rust.allow_dead_code", "Suppressed Lint: dead_code / unused", "unsafe_deprecated", "LOW", "561", r"#!?\[allow\((dead_code|unused)", text="raw"),
    _r("swift.force_unwrap", "Force Operation", "crash_factors", "MEDIUM", "476", r"\btry!|\bas!|[\w)\]]!(?![=\w])"),
    _r("swift.fatal_error", "Fatal Error", "crash_factors", "MEDIUM", "248", r"\bfatalError\("),
    _r("swift.insecure_transport", "Insecure Transport", "network_security", "MEDIUM", "319", r"\"http://", text="raw"),
    _r("swift.uiwebview", "Deprecated UIWebView", "unsafe_deprecated", "MEDIUM", "477", r"\bUIWebView\b"),
    _r("javascript.eval", "Dynamic Code Execution", "unsafe_exec", "HIGH", "95", r"(?<![.\w])eval\s*\(|new Function\("),
    _r("javascript.dom_xss", "DOM XSS Sink", "injection", "HIGH", "79", r"\.(innerHTML|outerHTML)\s*=|document\.write\(|dangerouslySetInnerHTML"),
    _r("javascript.insecure_transport", "Insecure Transport", "network_security", "MEDIUM", "319", r"[\"'`]http://(?!localhost|127\.)", text="raw"),
    _r("javascript.prototype_pollution", "Prototype Pollution", "injection", "HIGH", "1321", r"\[\s*[\"']__proto__[\"']\s*\]|\.__proto__\b", text="raw"),
    _r("javascript.cors_wildcard", "CORS Wildcard Origin", "session_mgmt", "MEDIUM", "942", r"(?i)Access-Control-Allow-Origin[\"']?\s*[,:]\s*[\"']\*|origin:\s*[\"']\*", text="raw"),
    _r("javascript.insecure_storage", "Sensitive Data in Web Storage", "insecure_data_storage", "MEDIUM", "922", r"(local|session)Storage\.setItem\(", shape="both", pattern2=_SECRET, text="raw"),
    _r("javascript.node_command_injection", "Node.js Command Injection", "io_validation", "HIGH", "78", r"\b(exec|execSync|spawn)\(\s*[`\"'].*\$\{|child_process\.exec\("),
    _r("javascript.sql_concat", "SQL Injection via Concatenation", "injection", "HIGH", "89", r"(?i)\.query\(\s*[`\"'](select|insert|update|delete)[^)]*(\$\{|\+)", text="raw"),
    _r("javascript.reject_unauthorized_false", "TLS Certificate Validation Disabled", "network_security", "HIGH", "295", r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED"),
    _r("javascript.math_random_security", "Math.random in Security Context", "cryptography", "MEDIUM", "338", r"Math\.random\(", shape="both", pattern2=_SECRET),
    _r("javascript.sensitive_logging", "Sensitive Data in Logs", "data_exposure", "MEDIUM", "532", r"console\.(log|info|debug|error)\(", shape="both", pattern2=_SECRET),
    _r("javascript.weak_crypto", "Weak Cryptography (Node.js)", "cryptography", "HIGH", "327", r"create(Hash|Cipher(iv)?|Hmac)\(\s*[\"'](md5|sha1|des|rc4)", text="raw"),
    _r("javascript.jwt_alg_none", "JWT Algorithm None", "authentication", "HIGH", "347", r"(?i)algorithms?\s*:\s*\[?\s*[\"']none", text="raw"),
    _r("javascript.jwt_no_algorithms", "JWT verify Without algorithms Allowlist", "authentication", "HIGH", "347", r"jwt\.verify\(", shape="without", pattern2=r"algorithms"),
    _r("javascript.open_redirect", "Open Redirect", "session_mgmt", "MEDIUM", "601", r"res\.redirect\(\s*req\."),
    _r("javascript.ssrf", "Server-Side Request Forgery", "network_security", "HIGH", "918", r"\b(fetch|axios(\.\w+)?)\(\s*req\."),
    _r("javascript.eval_settimeout", "eval-Equivalent in setTimeout / setInterval", "unsafe_exec", "MEDIUM", "95", r"set(Timeout|Interval)\(\s*[\"'`]", text="raw"),
    _r("javascript.no_helmet", "Express App Without Security Headers (helmet)", "platform_config", "LOW", "693", r"\bexpress\(\)", shape="guarded", pattern2=r"helmet"),
    _r("javascript.no_rate_limit", "Express App Without Rate Limiting", "platform_config", "LOW", "770", r"\bexpress\(\)", shape="guarded", pattern2=r"(?i)rate-?limit"),
    _r("universal.redos", "Regular Expression DoS (ReDoS)", "io_validation", "MEDIUM", "1333", r"\([^()]*[+*]\)[+*]", text="raw", skip=("//",)),
)


def _q(rule_id: str, name: str, severity: str, languages: tuple[str, ...], pattern: str, **more) -> Rule:
    return Rule(rule_id, name, "quality", severity, pattern, languages, **more)


_GO, _PY, _TS, _ALL = ("go",), ("python",), ("ts",), ()
QUALITY = (
    _q("dup-subexpr", "Identical operands", "MEDIUM", _GO, r"(?<![\w.])([A-Za-z_][\w.]*)\s*(==|!=|&&|\|\||<|>)\s*\1(?![\w.(\[])"),
    _q("sloppy-reassign", "Re-assignment in if-init", "LOW", _GO, r"\bif\s+err\s*=\s"),
    _q("py-mutable-default", "Mutable default argument", "HIGH", _PY, r"^\s*(async\s+)?def\s+\w+\(.*=\s*(\[\]|\{\}|list\(\)|dict\(\)|set\(\))"),
    _q("py-bare-except", "Bare except", "MEDIUM", _PY, r"^\s*except\s*:"),
    _q("py-is-literal", "`is` compared with a literal", "MEDIUM", _PY, r"\bis\s+(not\s+)?(\d|\"|')"),
    _q("py-singleton-compare", "Equality comparison with None/True/False", "LOW", _PY, r"[=!]=\s*(None|True|False)\b"),
    _q("py-assert-tuple", "assert on a tuple", "MEDIUM", _PY, r"^\s*assert\s*\([^()]*,[^()]*\)\s*$"),
    _q("py-wildcard-import", "Wildcard import", "LOW", _PY, r"^\s*from\s+\S+\s+import\s+\*"),
    _q("py-redefined-builtin", "Builtin name reassigned", "LOW", _PY, r"^\s*(list|dict|set|str|int|float|id|type|input|filter|map|sum|max|min|len|next|hash|object|bytes|format|range|print)\s*=\s*[^=]"),
    _q("py-self-assign", "Variable assigned to itself", "LOW", _PY, r"^\s*([A-Za-z_][\w.]*)\s*=\s*\1\s*$"),
    _q("py-dup-operand", "Identical operands", "MEDIUM", _PY, r"(?<![\w.])([A-Za-z_][\w.]*)\s*(==|!=|<|>|\band\b|\bor\b)\s*\1(?![\w.(\[])"),
    _q("py-fstring-no-placeholder", "f-string without placeholders", "LOW", _PY, r"(?<![\w\"'])f\"[^\"{}]*\"|(?<![\w\"'])f'[^'{}]*'", text="raw"),
    _q("join-small", "strings.Join on a tiny literal slice", "LOW", _GO, r"strings\.Join\(\[\]string\{[^,}]*,?[^,}]*\}"),
    _q("strings-compare", "strings.Compare", "LOW", _GO, r"strings\.Compare\("),
    _q("equal-fold", "Case-insensitive compare via ToLower/ToUpper", "LOW", _GO, r"strings\.To(Lower|Upper)\([^)]*\)\s*[=!]=\s*strings\.To"),
    _q("redundant-sprintf", "Redundant fmt.Sprintf(", "LOW", _GO, r"fmt\.Sprintf\(\s*\"%[sv]\"\s*,\s*\w+\s*\)", text="raw"),
    _q("dynamic-errorf", "fmt.Errorf with a non-constant format", "LOW", _GO, r"fmt\.Errorf\(\s*[A-Za-z_]\w*\s*\)"),
    _q("sprint-then-write", "Sprintf result passed to a writer", "LOW", _GO, r"\.Write(String)?\(\s*(\[\]byte\()?fmt\.Sprint"),
    _q("string-bytes-roundtrip", "Redundant string and []byte round trip", "LOW", _GO, r"string\(\[\]byte\(|\[\]byte\(string\("),
    _q("index-as-contains", "strings.Index compared with -1/0", "LOW", _GO, r"strings\.Index\([^)]*\)\s*(!=|==|>|>=)\s*(-1|0)"),
    _q("manual-quote", "Manually quoted %s", "LOW", _GO, r"\\\"%s\\\"|'%s'", text="raw"),
    _q("case-compare", "Case-insensitive compare via toLowerCase/toUpperCase", "LOW", ("java", "ts"), r"\.to(Lower|Upper)Case\(\)\s*(===?\s*\w+\.to|\.equals\()"),
    _q("length-zero", "length() compared with 0", "LOW", ("java",), r"\.(length|size)\(\)\s*(==|>|!=)\s*0"),
    _q("new-string", "new String(...)", "LOW", ("java",), r"new String\(\s*(\"\"|\w+)\s*\)"),
    _q("concat-chain", "String built with a + chain", "LOW", _ALL, r"(\"\"\s*\+\s*\w+\s*\+\s*){2,}"),
    _q("regex-in-func", "Constant regex compiled on every call", "LOW", _GO, r"^\s+\w+\s*:=\s*regexp\.MustCompile\("),
    _q("regex-must", "regexp.Compile on a constant pattern", "LOW", _GO, r"regexp\.Compile\(\s*(\"\"|``)"),
    _q("regex-redos", "Nested quantifier (catastrophic backtracking)", "MEDIUM", _ALL, r"(re\.compile|MustCompile|Pattern\.compile|new RegExp)\(.*\([^()]*[+*]\)[+*]", text="raw"),
    _q("perf-index-alloc", "strings.Index(string(b), ...)", "LOW", _GO, r"strings\.Index\(string\("),
    _q("perf-write-byte", "WriteRune with a single-byte rune", "LOW", _GO, r"\.WriteRune\('[^\\']'\)", text="raw"),
    _q("perf-string-writer", "Write([]byte(s)) on a writer", "LOW", _GO, r"\.Write\(\[\]byte\("),
    _q("wg-add-negative", "WaitGroup.Add(-1)", "LOW", _GO, r"\.Add\(\s*-1\s*\)"),
    _q("time-expr", "Manual time conversion", "LOW", _GO, r"\.(Nanoseconds|Milliseconds)\(\)\s*/\s*\d+|time\.Duration\(\d+\)\s*\*"),
    _q("http-no-body", "nil request body", "LOW", _GO, r"http\.NewRequest(WithContext)?\([^)]*,\s*nil\s*\)"),
    _q("marker-conflict", "Merge conflict marker", "HIGH", _ALL, r"^(<{7} \S|>{7} \S|={7}$)", text="raw"),
    _q("marker-diff", "Pasted diff header", "MEDIUM", _ALL, r"^(diff --git a/|@@ -\d+,\d+ \+\d+,\d+ @@)", text="raw"),
    _q("py-blocking-sleep", "Blocking sleep", "LOW", _PY, r"\btime\.sleep\("),
    _q("ts-loose-any", "Loose any type", "LOW", _TS, r":\s*any\b|as\s+any\b"),
    _q("ts-loose-equality", "Loose equality", "LOW", _TS, r"[^=!]==[^=]|!=[^=]"),
    _q("js-var", "var declaration", "LOW", _TS, r"^\s*var\s+\w"),
    _q("todo-marker", "Open TODO or FIXME", "LOW", _ALL, r"(?i)\b(todo|fixme|xxx)\b", text="raw"),
)

#: Acquire and release: (rule id, name, languages, acquire, release, ratio, margin). Fires for all acquire lines when acquires > floor(releases * ratio) + margin.
LEAKS = (
    ("go.context_cancel", "context.With* cancel func never called", ("go",), r"context\.With(Cancel|Timeout|Deadline)\(", r"\bcancel\w*\(\)|defer \w*[cC]ancel", 1.0, 0),
    ("go.ticker_stop", "time.Ticker never stopped", ("go",), r"time\.NewTicker\(", r"\.Stop\(\)", 1.0, 0),
    ("go.timer_stop", "time.Timer never stopped", ("go",), r"time\.NewTimer\(", r"\.Stop\(\)", 1.0, 0),
    ("go.file_handle", "os file handle never closed", ("go",), r"os\.(Open|Create|OpenFile)\(", r"\.Close\(\)", 1.0, 0),
    ("go.sql_handle", "sql.DB never closed", ("go",), r"sql\.Open\(", r"\.Close\(\)", 1.0, 0),
    ("go.http_body", "HTTP response body never closed", ("go",), r"http\.(Get|Post|Head)\(|\.Do\(", r"Body\.Close\(\)", 1.0, 0),
    ("go.sql_rows", "sql.Rows never closed", ("go",), r"\.Query(Context)?\(", r"\.Close\(\)", 1.0, 0),
    ("py.file_handle", "file handle never closed", ("python",), r"=\s*open\(", r"\.close\(\)|\bwith\b", 1.0, 0),
    ("py.socket_handle", "socket never closed", ("python",), r"socket\.socket\(", r"\.close\(\)|\bwith\b", 1.0, 0),
    ("py.threading_thread", "threading.Thread never joined", ("python",), r"threading\.Thread\(", r"\.join\(", 1.0, 0),
    ("py.popen_handle", "subprocess.Popen never waited on", ("python",), r"subprocess\.Popen\(", r"\.(wait|communicate|terminate|kill)\(|\bwith\b", 1.0, 0),
    ("py.asyncio_task", "asyncio task never awaited/cancelled", ("python",), r"\b(create_task|ensure_future)\(", r"\bawait\b|\.cancel\(|\bgather\(", 1.0, 0),
    ("java.executor_leak", "ExecutorService never shut down", ("java",), r"Executors\.new\w+\(", r"\.shutdown(Now)?\(\)", 1.0, 0),
    ("java.stream_leak", "file stream never closed", ("java",), r"new (File(Input|Output)Stream|File(Reader|Writer)|Buffered(Reader|Writer)|Scanner)\(", r"\.close\(\)|try \(", 1.0, 0),
    ("java.jdbc_connection", "JDBC Connection never closed", ("java",), r"getConnection\(", r"\.close\(\)|try \(", 1.0, 0),
    ("java.statement_leak", "Statement never closed", ("java",), r"\.(createStatement|prepareStatement|prepareCall)\(", r"\.close\(\)|try \(", 1.0, 0),
    ("java.resultset_leak", "ResultSet never closed", ("java",), r"\.executeQuery\(", r"\.close\(\)|try \(", 1.0, 0),
    ("ts.listener_leak", "addEventListener without a matching removeEventListener", ("ts",), r"\.addEventListener\(", r"\.removeEventListener\(|AbortController", 1.0, 0),
    ("ts.interval_leak", "setInterval without a matching clearInterval", ("ts",), r"\bsetInterval\(", r"\bclearInterval\(", 1.0, 0),
    ("ts.timeout_leak", "many setTimeout calls with no clearTimeout anywhere", ("ts",), r"\bsetTimeout\(", r"\bclearTimeout\(", 1000.0, 4),
    ("ts.blob_url_leak", "createObjectURL without a matching revokeObjectURL", ("ts",), r"\bcreateObjectURL\(", r"\brevokeObjectURL\(", 1.0, 0),
    ("ts.observer_leak", "MutationObserver never disconnected", ("ts",), r"new (Mutation|Resize|Intersection)Observer\(", r"\.disconnect\(", 1.0, 0),
    ("ts.raf_leak", "requestAnimationFrame without a matching cancelAnimationFrame", ("ts",), r"\brequestAnimationFrame\(", r"\bcancelAnimationFrame\(", 1.0, 0),
    ("rust.thread_join", "thread::spawn handle never joined", ("rust",), r"thread::spawn\(", r"\.join\(", 1.0, 0),
    ("rust.mem_forget", "std::mem::forget leaks its argument by design", ("rust",), r"mem::forget\(|Box::leak\(", r"Box::from_raw\(", 1.0, 0),
    ("swift.timer_invalidate", "Timer never invalidated", ("swift",), r"Timer\.scheduledTimer\(", r"\.invalidate\(\)", 1.0, 0),
    ("swift.notification_observer", "NotificationCenter observer never removed", ("swift",), r"addObserver\(", r"removeObserver\(", 1.0, 0),
    ("objc.notification_observer", "NotificationCenter observer never removed", ("objc",), r"addObserver:", r"removeObserver:", 1.0, 0),
    ("c.malloc_free", "heap allocation never freed", ("c", "cpp"), r"\b(m|c|re)alloc\(", r"\bfree\(", 1.0, 0),
    ("c.fopen_fclose", "FILE* never closed", ("c", "cpp"), r"\bfopen\(", r"\bfclose\(", 1.0, 0),
    ("cpp.thread_join", "std::thread never joined or detached", ("cpp",), r"\bstd::thread\s+\w+", r"\.(join|detach)\(", 1.0, 0),
)
