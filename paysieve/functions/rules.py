"""Detection rules as data: fixed patterns, marker lists, and staged signal / score definitions.

A stage is a list of ``(column, expression)``; each stage may use columns of earlier stages.  The
expressions use plain SQL plus four shorthands that are expanded by ``render``:

  rx(column,NAME)     the column matches PATTERNS[NAME]
  nrx(column,NAME)    number of matches
  anyof(column,NAME)  the column contains one of MARKERS[NAME]
  nof(column,NAME)    how many entries of MARKERS[NAME] the column contains
"""

from __future__ import annotations

import re
from collections.abc import Callable

LABELS = ["Normal", "SQLi", "XSS", "CMD", "PathTraversal", "FileInclusion", "XXE", "PromptInjection"]
ATTACKS = LABELS[1:]

# Regular expressions of the signal rules (portable between Java and RE2).
PATTERNS = {
    "NUL": "\\x00",
    "NON_ASCII": r"[^\x00-\x7F]",
    "FULLWIDTH": "[＀-￯]",
    "ZERO_WIDTH": "[​‌‍‮]",
    "HEX32_PARAM": r"(?i)(?:^|[&?])(\w+)=([0-9a-f]{32})\b",
    "HEX32_TOKEN": r"(?i)\b[0-9a-f]{32}\b",
    "HEX32_WHOLE": r"(?i)^\s*[0-9a-f]{32}\s*$",
    "HEX32_UPPER": r"^\s*[0-9A-F]*[A-F][0-9A-F]*\s*$",
    "HEX32_VALUE": r"(?i)(?:^|[&?])\w+=\s*[0-9a-f]{32}\s*(?:&|$)",
    "HAS_UPPER_HEX": "[A-F]",
    "HAS_LOWER_HEX": "[a-f]",
    "FORM_INJ": r"(?i)(pwd|passwd|password|login|user|modo)=",
    "FORM_CTX": r"(?i)(modo|login|pwd|password|insert|registro|entrar)=",
    "SCRIPT_SPLIT": r"['\"]\s*\+\s*['\"]",
    "CONCAT_SPLIT": r"'\s*\+\s*'",
    "PARAM_NAME": r"(?:^|[&?])(\w+)=([^&]*)",
    "PARAM_MIXED": (r"(?:^|[&?])(?:\w+[a-z]\w*[A-Z]\w*|[a-z]\w+[A-Z]\w*|[a-z]\w*[A-Z]\w+"
                    r"|\w+[A-Z]\w*[a-z]\w*|[A-Z]\w+[a-z]\w*|[A-Z]\w*[a-z]\w+)="),
    "UNICODE_ESCAPE": r"(?i)\\u[0-9a-f]{4}",
    "NULL_IN_VALUE": r"(?i)[\w.]%00|%00[\w.@]|%00%23|%3d%00|%00%3d|\w%00\w|%2500",
    "NULL_SPLICE": r"(?i)[a-z0-9]{2,}(?:%00|\x00)[a-z0-9@.]+|(?:%00|\x00)[a-z0-9@.]{3,}|[a-f0-9]{16,}(?:%00|\x00)[0-9a-f]*",
    "NULL_BETWEEN": r"\w%00\w",
    "BENIGN_FORM": r"(?i)(modo|login|password|nombre|apellidos|precio|pwd|insertar|registro|entrar|b1|cantidad|email|dni|direccion|ciudad|cp|provincia|ntc)=[^&]*",
    "BENIGN_SHOP": r"(?i)(?:^|[&?])(id|nombre|precio|cantidad|producto)=[^&]*",
    "STREET": r"(?i)(?:calle|carrer|cami|camin|avenida|paseo|plaza|pla|rambla|passatge|avinguda|travesia|porta)(?:\b|[+\s,%])|c/(?:[+\s]|%2b|[A-Za-zÁÉÍÓÚÑáéíóúñ])",
    "ADDRESS_SAFE": r"^[\w\s+,.\-'áéíóúñüàèòçÁÉÍÓÚÑÜÀÈÒÇ?%/]+$",
    "NAME_TOKEN": r"^[A-Za-zÁÉÍÓÚÑÜáéíóúñüàèòç]+(?:[+\s][A-Za-zÁÉÍÓÚÑÜáéíóúñüàèòç]+){0,3}$",
    "NAME_LOOSE": r"^[A-Za-zÁÉÍÓÚÑÜáéíóúñüàèòça'\s\-]{4,48}$",
    "LETTER": r"\p{L}",
    "SQLI_MARK": r"(?i)union\s+select|select\s+.+\s+from|insert\s+into|drop\s+table|sleep\s*\(|benchmark\s*\(|or\s+1\s*=\s*1|'[^']*'|--|%27|%2527|%2d%2d|0x[0-9a-f]{4,}|;\s*shutdown",
    "ADDRESS_VETO": r"(?i)union\s+select|select\s+.+\s+from|insert\s+into|drop\s+table|sleep\s*\(|benchmark\s*\(|or\s+1\s*=\s*1|--|%2527|%2d%2d|0x[0-9a-f]{4,}",
    "ANOMALY_FIELDS": (
        r"(?i)(?:^|[&?])(?:b1a=|b1=\?|b1=%3f|provincia=\||provincia=%7c)"
        r"|pwd=[^&]{0,48}%2b"
        r"|(?:^|[&?])(?:modo|precio|login|pwd|password|nombre|direccion|cantidad|email)[a-z]\s*="
        r"|(?:modo|precio|nombre|cantidad|apellidos|direccion|ciudad)=[^&]*(?:\||%7c)"
        r"|(?:cantidad|b1)=[^&]*(?:\?|%3[fF]|/)"
        r"|(?:b1)=[^&]*/(?:$|&)"
        r"|(?:login|pwd|password|nombre|email|cp|b1)=(?:%20|\+|%2b|\s*|%00|\x00)(?:$|&)"
        r"|(?:login|pwd)=[^&]*%2b"
        r"|(?:pwd|password)=[^&]*[!*,]"
        r"|(?:pwd|password)=[^&]*%3f"
        r"|(?:direccion)=[^&]*\*"
        r"|(?:b1)=[^&]*%20(?:$|&)"
        r"|(?:b1)=[^&]+\s+(?:$|&)"
        r"|remember=on/"
        r"|remember=on%2[fF]"
        r"|(?:modo|precio|login|pwd|password|nombre|direccion)[a-z]%3d"
        r"|(?:cantidad|b1)%3d[^&]*(?:%3[fF]|%3f)"
        r"|(?:login|pwd|password|nombre|apellidos|email|cp|b1)%3d(?:%20|%2b|$|%26)"
        r"|(?:apellidos|provincia|direccion)%3d(?:%7c|[^&]*%7c)"
        r"|remember%3don%2[fF]"
        r"|(?:direccion|apellidos|ciudad)=[^&]*\|"
        r"|(?:email|cp|nombre|pwd)=\s*(?:$|&)"),
    "TAIL_BLANK": r"(?:cantidad|b1|precio)=[^&]*(?:\?|%3f|\||%7c|%20(?:$|&))",
    "LOGIN_PLUS": r"(?:login|pwd)=[^&]*%2b",
    "PWD_QUESTION": r"(?:pwd|password)=[^&]*%3f",
    "FIELD_BLANK": r"(?:pwd|nombre|apellidos|email|cp)=(?:%20|\||%7c|\+|\s*)(?:$|&)",
    "VALUE_TAIL_BLANK": "=[^&=]*%(?:20|2520)(?:$|&|\")",
    "FIELD_EMPTY": r"(?:email|cp|nombre|pwd)=\s*(?:$|&)",
    "FULL_ENC_FORM": r"(?i)(?:modo|login|password|precio|nombre|b1|id)%3d.{0,40}%26.{0,80}(?:%3d|%26)",
    "OPAQUE_URL": (r"(?i)^https?%3a//|^https?%253a|http%3a//[^&]{8,}(?:%40|%2540)"
                   r"|http%3a%2f%2f[^&]{6,}(?:%40|%23|%2540|%2523)|%253a%2f%2f[^&]{8,}(?:%40|%2540)"),
    "DYNAMIC_MARK": (
        r"(?i)(?:%0a|\n).{0,32}set-?cookie|tamper%3d|tamper=|passw%68|(?:^|[&?])logina=|ciudada="
        r"|%3cscript|%253cscript|alert%28|alert\(|%06|%05|%0d|(?:^|[&?=])do&nombre=|do%0a[&/]|nombre\s+like"
        r"|%24(?:apellidos|email|dni|direccion)|%3fapellidos|\band\s+\d+\s*[<>=]\s*\d+\b|%252e|/etc/passwd"),
    "HTML_ENTITY_XSS": (
        r"(?i)&#\d+;.{0,120}(?:script|alert|onerror|onload|svg|&#83;&#67;|&#115;&#99;)"
        r"|(?:script|alert|onerror|&#83;&#67;Ri|&#115;&#99;).{0,120}&#\d+;"
        r"|&#\d+;[^&]{0,40}@<&#"
        r"|&#\s*0*60\s*;(?:&#\s*\d+\s*;){2,80}"
        r"|(?:&#\s*0*115\s*;|&#\s*0*83\s*;).{0,40}(?:&#\s*0*99\s*;|&#\s*0*67\s*;)"
        r"|(?:&#\s*0*97\s*;).{0,20}(?:&#\s*0*108\s*;).{0,20}(?:&#\s*0*101\s*;).{0,20}(?:&#\s*0*114\s*;)"),
    "ENTITY_BROKEN": r"&#\s*0*60\s*;?\s*s|(?:scr|sc&#|s&#\s*0*99)|ale&#\s*0*114|aler&#|&#\s*0*97\s*;?l|&#\s*1?\s*&#?\s*\d+",
    "JSON_NESTED": r"(?s)\{\s*\"a\"\s*:\s*\{\s*\"b\"\s*:\s*\"(.*?)\"\s*\}\s*\}",
    "DOUBLE_PCT": r"(?i)%25(?:25)?[0-9a-f]{2}",
    "DOUBLE_CMD": (r"(?i)(?:%2528|%28%25|%\d{2}%25)\s*(?:echo|wget|curl|sleep|bash|sh\b)"
                   r"|(?:%2526%2526|%26%26%25|%25253b)\s*(?:echo|wget|curl)|str%25(?:25)?3d%25(?:25)?(?:24|%24)%25(?:25)?28"),
    "DOUBLE_QUOTE_SLASH": "%2527|%2522|%252f",
    "WEAK_SQLI": (r"(?i)(?:/\*!?\d*\*/|/\*\*/|#|%23)|(?:sel|uni|ins|upd|del)(?:/\*.*?\*/|%09|%0a|%0b)(?:ect|on|ert|ete)"
                  r"|(?:or|and)\s*(?:'[^']*'|1e\d*)\s*=\s*(?:'[^']*'|1e\d*)"),
    "WEAK_CMD": r"(?i)(?:\$\{IFS\}|\{cat,|\|\||%0a)(?:wget|curl|bash|sh\b)",
    "BOOL_LIKE": r"(?i)\b(?:and|or)\b\s+\d+(?:\.\d+e\d+)?\s+like\s+\d+(?:\.\d+e\d+)?\b",
    "SCI_NOTATION": r"(?i)(?:^|[^0-9a-f])1e0(?:[^0-9a-f]|$)",
    "XML_DECL": r"(?i)<\?xml\b",
    "DOCTYPE": r"(?i)<!doctype\b",
    "ENTITY": r"(?i)<!entity\b",
    "PARAM_ENTITY": r"(?i)<!entity\s+%",
    "PE_CHAIN": r"(?i)%\w+\s*;\s*%\w+",
    "FILE_URI": r"(?i)file:///",
    "SYS_SPLIT": "(?is)<!entity\\s+%[^>]+\"sys\"[^>]*>.*?<!entity[^>]+\"tem\"",
    "ENTITY_REF": r"(?i)&\w+\s*;",
    "HEX_SYSTEM": r"(?i)&#x53;&#x59;&#x53;&#x54;&#x45;&#x4d",
    "HEX_FILE": r"(?i)&#x66;&#x69;&#x6c;&#x65;&#x3a;&#x2f;&#x2f;&#x2f;",
    "HEX_PCT_ENTITY": r"(?i)<!ENTITY\s+&#x25;\s*\w+",
    "LOCAL_DTD": r"(?i)\.dtd['\"]",
    "SVG": r"(?i)<svg\b",
    "PE_REF": r"%\w+\s*;",
    "SHELL_ECHO": r"(?i)(?:&&|\|\||%26%26|%7c%7c).{0,24}e?c?h?o|(?:^|[?&])e?c?h?o\s*%20|\$\(\s*e?c?h?o|ech[o0]\$|\$\(\s*\d+%2b",
    "ECHO": r"(?i)echo|\$\(\s*echo",
    "ENC_NAME": r"(?i)%2b|%40|%ef%bf%bd|%2c%2b|%2e%2b",
    "PRODUCT_TAIL": r"(?i)^(?:vino|queso|jam(?:on|%c3%b3n)|iberico)(?:\+|%2b|%252b)[^\r\n&]{0,48}(?:%2b|%252b)$",
    "STREET_JOIN": r"(?i)(?:calle|avenida|paseo|plaza|travesia|rambla|carrer|cami|passatge|avinguda|c/%2f)(?:%252b|%2b)",
    "PCT_PLUS_END": "(?:%252b|%2b)$",
    "CRLF": r"(?:%0d%0a|%0a|%0d|\r\n|\n)",
    "CRLF_COOKIE": r"(?:%0d%0a|%0a|%0d|\r\n|\n).{0,8}set-cookie",
    "COOKIE_COLON": r"set-cookie\s*%3a",
    "COOKIE_TAMPER": r"set-cookie\s*%3a\s*\+?tamper",
    "OVERLONG_DOTS": r"(?:\.\.|%2e%2e).{0,8}%c0%af",
    "MAIL_DOUBLE": r"(?i)^[a-z0-9_.+\-]+%2540[a-z0-9_.\-]+\.[a-z]{2,}$",
    "FIELD_SUFFIX": r"(?:modo|precio|login|pwd|password|nombre|direccion)[a-z]\s*=",
    "QTY_ODD": r"(?:cantidad|b1)=[^&]*[?%]",
    "PWD_ODD": r"(?:pwd|password)=[^&]*[!*,]",
    "ID_PARAM": r"(?:^|[&?])id\s*=",
    "COMMENT_PARAM": r"(?:modo|login|password|precio)/\*\*/=",
    "CASE_QTY": r"(?:cantidad|b1|nombre)=[^&]*[?%|]",
    "CASE_ADDR": r"(?:direccion|apellidos)=[^&]*[?|]",
    "HEX_OR_PCT": r"(?:\\x|%)[0-9a-f]{2}",
    "VIEW_SQL": r"union\s+select|select\s+.+\s+from|or\s+1\s*=\s*1|sleep\s*\(|benchmark\s*\(",
    "VIEW_ENTITY": r"(?i)&#x?[0-9a-f]+;?",
    "HPP_NAMES": r"(?:^|[&?])(\w+)=",
    "ONLY_P_HEX": r"^\s*(?:[A-Za-z0-9_]{1,32}=)?[0-9A-F]{32}\s*$",
    "SUSPICIOUS_WORD": r"[a-z]{3,}",
    "EVAL_ATOB": r"eval\(atob|eval%28atob",
}

# Marker lists.
MARKERS = {
    "OBF": ["%", "/**/", "fromcharcode", "eval(", "&#", "\\u", "0x", "char(", "boundary=", "multipart", "/*!", "%0a", "%09",
            "webkitformboundary", "%252", "\\x", "concat(", "unhex(", "benchmark(", "sleep(", "%00", "atob(", "echo%20",
            "&&echo", "$(echo", "'+'", "\"+\"", "between", "${ifs}", "{cat,", "/???/", "php://filter", "zip://",
            "xi:include", "data:text/html", "ontoggle", "font-size:0", "boundary*0=", "%c0%af", "%u2215", "[SYSTEM]", "||", "BETWEEN"],
    "STRONG": ["%252", "%00", "webkitformboundary", "/**/", "fromcharcode", "eval(", "\\u", "0x", "boundary=", "multipart", "\\x",
               "&&echo", "$(echo", "%0aecho", "atob(", "unhex(", "benchmark(", "concat(", "/*!", "echo%20", "echo%2520",
               "boundary*0=", "php://filter", "zip://", "xi:include", "%c0%af", "data:text/html",
               "​", "‌", "‮", "ontoggle="],
    "WEAK": ["%0a", "%09", "char(", "sleep(", "&#", "'+'"],
    "ENC_CMD": ["echo%20", "echo%2520", "%28echo", "%2528echo", "$(echo", "str%3d%24%28echo", "str%3d$(echo",
                "str%25253d%252524%252528echo", "str%25253d", "%26%26", "%252526", "&&echo", "%0aecho", "%25250aecho", "|echo",
                "%7cecho", "sleep%20", "sleep%200", "$%00(echo", "%00(echo", "sleep%2520", "wc%2520", "tr%2520-d", "%25250a"],
    "KW_SQLi": ["union", "select", "or 1=1", "information_schema", "sleep(", "benchmark(", "0x", "char(", "\\u006d", "\\u006c", "\\u0070"],
    "KW_XSS": ["<script", "onerror", "javascript:", "alert(", "onload=", "<svg", "fromcharcode", "<scr"],
    "KW_CMD": ["wget", "curl", "`", "${jndi:", "echo ", "sleep ", "echo%20", "%28echo", "$(echo", "str%3d%24%28echo", "str=$(echo",
               "%26%26", "sleep%20", "|echo", "%2528echo", "echo%2520", "%252526", "&&", "||", ";wget", "|wget", "%3bwget", "%7cwget"],
    "KW_PathTraversal": ["../", "..\\", "/etc/passwd", "%2e%2e"],
    "KW_FileInclusion": ["php://", "file://", "expect://", "data://"],
    "KW_XXE": ["<!entity", "<!doctype", "<?xml", "&xxe;", "file:///", "<!entity %", "system", "public"],
    "KW_PromptInjection": ["ignore previous", "jailbreak", "system prompt", "disregard", "[system]", "validation: approved", "忽略", "ignore​"],
    "UNI_WORDS": ["echo", "sleep", "str=", "union", "select", "modo", "login", "pwd"],
    "UNI_FIXED": ["\\u006d", "\\u006c", "\\u0070"],
    "ADDR_WORDS": ["union", "select", "script", "alert", "wget", "eval(", "${jndi"],
    "ENTITY_WORDS": ["script", "alert", "onerror", "&#115;", "&#99;", "&#97;", "atob"],
    "ENTITY_STRONG": ["&#60;", "&#060;", "&#x3c;", "onerror", "atob"],
    "FORM_NAMES": ["modo=", "login=", "password=", "nombre=", "apellidos="],
    "FULL_NAMES": ["modo", "precio", "login"],
    "FULL_NAMES2": ["modo", "precio", "login", "password"],
    "SQL_PHRASES": ["drop table", "union select", "insert into"],
    "ATOB_WORDS": ["modo", "login", "pwd", "union", "select", "drop", "insert", "script"],
    "CMD_HINT": ["&&", "%26%26", "|echo", "%7cecho", "wget", "curl", "bash", "sh%20", "str%3d%24%28echo", "$(echo"],
    "NUL_SHELL": ["$(echo", "str%3d%24", "str%3d%24%28echo", "sleep%20", " -ne ", " -eq ", "%20-ne%20", "%20-eq%20"],
    "CONCAT_WORDS": ["insert", "select", "union", "script", "alert", "drop"],
    "HPP_WORDS": ["<script", "alert(", "union", "select", "jndi:", "${"],
    "SLEEP_TEST": [" -ne ", " -eq ", "%20-ne%20", "%20-eq%20", "||", "%7c%7c", "wc"],
    "SCRIPT_PIECES": ["script", "alert", "scr", "ipt"],
    "SCRIPT_MULTI": ["script", "alert", "<scr"],
    "ATOB_SCRIPT": ["script", "alert", "select", "union"],
    "ECHO3": ["&&echo", "$(echo", "%0aecho"],
    "MULTI_CMD": ["&&echo", "%26%26", "|echo", "%7cecho", "%27&&"],
    "STR_ECHO": ["str%3d%24%28echo", "str=$(echo", "${#str}"],
    "WRAPPERS": ["php://filter", "zip://", "xi:include"],
    "SHELL_BLANK": ["${ifs}", "{cat,", "/???/"],
    "SHELLISH": ["$(echo", "&&echo", "%0aecho", "|echo", "sleep 0", "sleep 1", " -ne ", " -eq ", "%20-ne%20", "%20-eq%20",
                 "wc -c", "tr -d", "${#str}", "str=$(", "str%3d%24%28echo"],
    "XSS_MARK": ["<script", "</script", "onerror=", "onload=", "onmouseover=", "javascript:", "svg/onload", "<svg", "<img",
                 "fromcharcode", "document.cookie", "&#60;script", "%3cscript"],
    "PATH_MARK": ["../", "..\\", "%2e%2e%2f", "%2e%2e/", "....//", "etc/passwd", "windows/system32", "boot.ini"],
    "FI_MARK": ["php://", "file://", "expect://", "zip://", "phar://", "input://", "data://text", "filter/convert"],
    "ATOB_NO_B64": ["sleep", "echo", "|tr", "wc-c", "wc%20", "%7c%7c"],
    "ATOB_CMD": ["echo", "wget", "curl", "sleep", "bash", "$(", "${", "&&", "||", "wc -c", "wc%20", "tr -d", "tr%20-d", "%28echo", "$(echo", "str=$("],
    "ATOB_SQL": ["union", "select", "drop", "insert", "script", "alert", "waitfor"],
    "ATOB_FORM": ["modo", "login", "password", "pwd"],
    "ATOB_PIPE": ["sleep", "|tr", "wc -c", "%7c%7c", "||"],
    "PRIOR_SQL": ["union", "select", "or 1=1", "sleep(", "benchmark(", "information_schema"],
    "PRIOR_COMMENT": ["/**/", "%27", "%20or%20", "char(", "concat(", "0x"],
    "PRIOR_XSS": ["<script", "onerror", "javascript:", "alert(", "onload=", "<svg"],
    "PRIOR_XSS_ENC": ["&#", "\\u003c", "%3cscript"],
    "PRIOR_CMD": [";", "|", "wget", "curl", "`", "${jndi:", "&&", "||"],
    "PRIOR_PATH": ["../", "..\\", "%2e%2e", "/etc/passwd"],
    "PRIOR_FILE": ["php://", "file://", "expect://"],
    "PRIOR_XXE": ["<!entity", "&xxe;"],
    "PRIOR_PROMPT": ["ignore previous", "jailbreak", "system prompt", "disregard"],
    "PRIOR_PAIRS": ["union", "select", "%27", "--", " or ", " and ", "sleep(", "benchmark(", "0x"],
    "SEM_PROMPT": ["ignore previous", "jailbreak", "system prompt"],
    "SQL_WORDS": ["union", "select", "sleep", "benchmark", "or 1=1", "drop", "insert", "update"],
    "XSS_WORDS": ["script", "onerror", "svg", "iframe", "javascript", "alert", "onload"],
    "DEEP_MARK": ["%", "&#", "\\u", "/**/", "0x", "char(", "eval(", "boundary="],
    "SUSPICIOUS": ["union", "select", "script", "alert", "entity", "system", "ignore", "prompt", "drop", "insert", "onerror", "jailbreak", "eval", "exec"],
    "VIEW_SQL2": ["information_schema", " waitfor ", " drop table", " insert into", " char("],
    "VIEW_XSS": ["<script", "javascript:", "onerror", "onload", "<svg", "alert("],
    "VIEW_XSS2": ["script", "alert", "onerror", "&#60;", "&#x3c;"],
    "VIEW_CMD": ["$(echo", "&&", "||", ";wget", "|wget", "curl ", "bash ", " sh ", "wc -c"],
    "VIEW_CMD2": [" -ne ", " -eq ", "str=$", "${#"],
    "VIEW_PATH": ["../", "..\\", "/etc/passwd", "%c0%af", "%2e%2e", "%u2215"],
    "VIEW_FILE": ["php://", "zip://", "file://", "expect://", "data://"],
    "VIEW_XXE": ["<!entity", "<!doctype", "&xxe;", "system \"file://", "xi:include"],
    "VIEW_PROMPT": ["ignore previous", "system prompt", "jailbreak", "validation: approved", "[system]"],
}


# A pattern can only match a text that holds one of these literals (no letters, so case does not
# matter); the engine tests them first and skips the regular expression on most texts.
GATES = {
    **dict.fromkeys(["FORM_INJ", "FORM_CTX", "BENIGN_FORM", "BENIGN_SHOP", "PARAM_MIXED", "HEX32_PARAM", "HEX32_VALUE", "TAIL_BLANK", "LOGIN_PLUS", "PWD_QUESTION", "FIELD_BLANK",
                     "VALUE_TAIL_BLANK", "FIELD_EMPTY", "FIELD_SUFFIX", "QTY_ODD", "PWD_ODD", "ID_PARAM", "CASE_QTY", "CASE_ADDR"], ["="]),
    "ANOMALY_FIELDS": ["=", "%"],
    **dict.fromkeys(["NULL_IN_VALUE", "NULL_BETWEEN", "OPAQUE_URL", "DOUBLE_CMD", "ENC_NAME", "PE_CHAIN", "PE_REF", "DOUBLE_QUOTE_SLASH"], ["%"]),
    **dict.fromkeys(["DOUBLE_PCT", "MAIL_DOUBLE"], ["%25"]), **dict.fromkeys(["FULL_ENC_FORM", "COOKIE_COLON", "COOKIE_TAMPER"], ["%3"]),
    **dict.fromkeys(["STREET_JOIN", "PCT_PLUS_END", "PRODUCT_TAIL"], ["%2"]), "NULL_SPLICE": ["%00", "\x00"],
    **dict.fromkeys(["HTML_ENTITY_XSS", "ENTITY_BROKEN", "HEX_SYSTEM", "HEX_FILE"], ["&#"]), "ENTITY_REF": ["&"],
    **dict.fromkeys(["XML_DECL", "DOCTYPE", "ENTITY", "PARAM_ENTITY", "SYS_SPLIT", "HEX_PCT_ENTITY", "SVG"], ["<"]),
    "NUL": ["\x00"], "UNICODE_ESCAPE": ["\\"], "VIEW_ENTITY": ["&#"], "SHELL_ECHO": ["&&", "||", "%", "$"], "WEAK_SQLI": ["/*", "#", "%", "="],
    # These patterns tell cases apart, so their letters count in any column.
    "CRLF": ["%0d", "%0a", "\r", "\n"], "CRLF_COOKIE": ["set-cookie"], "OVERLONG_DOTS": ["%c0%af"], "HEX_OR_PCT": ["\\x", "%"], "EVAL_ATOB": ["atob"],
    "VIEW_SQL": ["union", "select", "or", "sleep", "benchmark"],
    "FILE_URI": [":///"], "LOCAL_DTD": ["."], "JSON_NESTED": ["{"], "COMMENT_PARAM": ["/**/"], "CONCAT_SPLIT": ["'"], "SCRIPT_SPLIT": ["+"],
}
# The same for lower-cased columns, where a pattern that ignores case needs its letters in lower case.
LOWERED = {"raw_low", "low", "klow", "folded", "dform", "uraw", "ulow", "low_sp", "raw_low_pp", "low_pp", "addr", "addr_name", "addr_np", "reasm", "nocomment", "inner_low"}
LOW_GATES = {
    "SQLI_MARK": ["union", "select", "insert", "drop", "sleep", "benchmark", "=", "'", "--", "%2", "0x", "shutdown"],
    "ADDRESS_VETO": ["union", "select", "insert", "drop", "sleep", "benchmark", "=", "--", "%2", "0x"],
    "STREET": ["calle", "carrer", "cami", "avenida", "paseo", "pla", "rambla", "passatge", "avinguda", "travesia", "porta", "c/"],
    "DYNAMIC_MARK": ["%", "cookie", "tamper", "logina=", "ciudada=", "alert(", "do&nombre=", "like", "and", "/etc/passwd"],
    "ANOMALY_FIELDS": ["b1", "provincia", "pwd", "modo", "precio", "login", "password", "nombre", "direccion", "cantidad", "email", "apellidos", "ciudad", "cp", "remember"],
    "BOOL_LIKE": ["like"], "SCI_NOTATION": ["1e0"], "ECHO": ["echo"], "WEAK_CMD": ["wget", "curl", "bash", "sh"],
}
# Patterns of characters beyond ASCII only: a text with as many bytes as characters has none.
WIDE = {"FULLWIDTH", "ZERO_WIDTH", "NON_ASCII"}
# Literals that several entries of a marker list share; a text without one is not searched for its entries.
SHARED = ["%", "echo", "(", "\\", "://", "&", "<", "|", "script", "=", " "]


def marker_groups(markers: list[str]) -> list[tuple[str | None, list[str]]]:
    """Entries by the shared literal that covers most of the remaining ones (at least three); the rest stand alone."""
    out, rest = [], list(markers)
    while rest:
        key = max(SHARED, key=lambda g: sum(g in x for x in rest))
        found = [x for x in rest if key in x]
        if len(found) < 3:
            return [*out, (None, rest)]
        out.append((key, found))
        rest = [x for x in rest if key not in x]
    return out


def render(text: str, lit: Callable[[str], str], matches: Callable[[str, str], str], count: Callable[[str, str], str], gated: bool = False) -> str:
    """Expand the four shorthands with the literal and regex syntax of one SQL dialect."""
    def found(col, words):
        return "(" + " OR ".join(f"contains({col},{lit(x)})" for x in words) + ")"

    def total(col, words):
        return "(" + "+".join(f"CAST(contains({col},{lit(x)}) AS INT)" for x in words) + ")"

    def gates(col, name):
        tests = [found(col, g[name]) for g in (GATES, LOW_GATES if col in LOWERED else {}) if name in g]
        return tests + [f"octet_length({col})<>length({col})"] if name in WIDE else tests

    def regex(m):
        hit = matches(m[1], lit(PATTERNS[m[2]]))
        tests = gates(m[1], m[2]) if gated else []
        return "(" + " AND ".join([*tests, hit]) + ")" if tests else hit

    def times(m):
        n = count(m[1], lit(PATTERNS[m[2]]))
        tests = gates(m[1], m[2]) if gated else []
        return f"(CASE WHEN NOT ({' AND '.join(tests)}) THEN 0 ELSE {n} END)" if tests else n

    def has(m):
        if not gated:
            return found(m[1], MARKERS[m[2]])
        return "(" + " OR ".join(f"({found(m[1], [key])} AND {found(m[1], words)})" if key else found(m[1], words) for key, words in marker_groups(MARKERS[m[2]])) + ")"

    def number(m):
        if not gated:
            return total(m[1], MARKERS[m[2]])
        return "(" + "+".join(f"CASE WHEN NOT {found(m[1], [key])} THEN 0 ELSE {total(m[1], words)} END" if key else total(m[1], words) for key, words in marker_groups(MARKERS[m[2]])) + ")"
    text = re.sub(r"\bnof\((\w+),(\w+)\)", number, text)
    text = re.sub(r"\banyof\((\w+),(\w+)\)", has, text)
    text = re.sub(r"\bnrx\((\w+),(\w+)\)", times, text)
    return re.sub(r"\brx\((\w+),(\w+)\)", regex, text)


def cnt(col: str, token: str) -> str:
    return f"((length({col})-length(replace({col},'{token}','')))/{len(token)})"


def peak(prefix: str) -> str:
    return "greatest(" + ",".join(f"{prefix}_{k}" for k in ATTACKS) + ")"


def best(prefix: str) -> str:
    """First attack label that reaches the peak."""
    return "CASE " + " ".join(f"WHEN {prefix}_{k} >= {peak(prefix)} THEN '{k}'" for k in ATTACKS) + " END"


def scaled(prefix: str, src: str, labels: list[str] = LABELS) -> list[tuple[str, str]]:
    total = "+".join(f"{src}_{k}" for k in labels)
    return [(f"{prefix}_{k}", f"CASE WHEN ({total})=0 THEN 0.0D ELSE {src}_{k}/({total}) END") for k in labels]


def _xxe(m: str, d: str) -> str:
    """Structure score of canonical text m and its deep view d, capped at 1."""
    either = [("XML_DECL", .22), ("DOCTYPE", .28), ("ENTITY", .24), ("PARAM_ENTITY", .32), ("PE_CHAIN", .22),
              ("FILE_URI", .38), ("SYS_SPLIT", .42), ("LOCAL_DTD", .32)]
    terms = [f"CASE WHEN rx({m},{p}) OR rx({d},{p}) THEN {w}D ELSE 0D END" for p, w in either]
    terms += [f"CASE WHEN {c} THEN {w}D ELSE 0D END" for c, w in [
        (f"rx({d},ENTITY_REF) AND rx({d},ENTITY)", .18),
        (f"contains(lower({d}),'utf-16') AND rx({d},DOCTYPE)", .12),
        (f"rx({m},HEX_SYSTEM) OR (contains(lower({d}),'system') AND rx({d},PARAM_ENTITY))", .36),
        (f"rx({m},HEX_FILE) OR contains({d},'file:///')", .40),
        (f"rx({m},HEX_PCT_ENTITY)", .34),
        (f"rx({d},SVG) AND rx({d},DOCTYPE)", .26),
        (f"rx({d},PE_REF) AND rx({d},ENTITY)", .20),
        (f"contains(lower({d}),'fonts.dtd') OR contains(lower({d}),'fontconfig')", .18)]]
    # no markup character, no score: keeps the regexes off plain text
    return f"CASE WHEN contains({m},'<') OR contains({m},'%') OR contains({m},'&') OR contains({m},'file:') OR contains({m},'.dtd') OR contains(lower({m}),'font') THEN least(1.0D, {'+'.join(terms)}) ELSE 0.0D END"


def _strong(c: str, pct: str) -> str:
    return (f"rx({c},NUL) OR anyof({c},STRONG) OR rx({c},FULLWIDTH) OR anyof({c},ENC_CMD) OR nrx({c},UNICODE_ESCAPE)>=3"
            f" OR ({pct}>=4 AND {pct}/greatest(length({c}),1)>0.18) OR (nof({c},WEAK)>=2 AND {pct}>=2) OR rx({c},ZERO_WIDTH)")


def _benign_form(raw: str, rl: str, strong: str) -> str:
    """Ordinary shop / login form: form fields present and none of the vetoes."""
    veto = [f"rx({raw},PARAM_MIXED)", f"contains({raw},'/**/')", f"contains({raw},'/*!*/')", "contains(low,'/**/')", f"dup_{rl}",
            f"an_{rl}", "an_low", f"(contains({rl},'%3d') AND NOT contains({raw},'=') AND anyof({rl},FULL_NAMES))",
            f"rx({rl},TAIL_BLANK)", f"rx({rl},LOGIN_PLUS)", f"rx({rl},PWD_QUESTION)", f"rx({rl},FIELD_BLANK)", f"rx({rl},VALUE_TAIL_BLANK)",
            "contains(norm,'|')", f"contains({rl},'%7c')", f"contains({rl},'remember=on%2f')", f"contains({rl},'remember%3don%2f')",
            "rx(low,FIELD_EMPTY)", "substr(ltrim(norm),1,1)='@'", f"substr({rl},1,3)='%40'", f"rx({rl},OPAQUE_URL)", "rx(low,OPAQUE_URL)",
            f"rx({rl},DYNAMIC_MARK)", "rx(low,DYNAMIC_MARK)", strong, "sq_low", f"sq_{rl}",
            f"contains({raw},'''')", f"contains({rl},'%27')", f"contains({rl},'%2527')", f"rx({raw},CONCAT_SPLIT)"]
    return "(rx(low,BENIGN_FORM) OR rx(low,BENIGN_SHOP)) AND NOT (" + " OR ".join(veto) + ")"


def _pct_plus(rl: str) -> str:
    """Street address joined or ended by encoded plus signs."""
    plain = "(low<>'' AND NOT contains(low,'%') AND (contains(low,'+') OR contains(low,' ')) AND (rx(low_sp,STREET) OR rx(low_sp,ADDRESS_SAFE)))"
    return (f"{rl}<>'' AND NOT contains({rl},'=') AND NOT contains({rl},'&') AND NOT ({plain} AND NOT contains({rl},'%252'))"
            f" AND (rx({rl},STREET_JOIN) OR rx({rl}_pp,STREET)) AND (rx({rl},PCT_PLUS_END) OR {cnt(rl, '%252b')}>=2"
            f" OR (contains({rl},'%252c') AND contains({rl},'%252b')) OR contains({rl},'%253f') OR {cnt(rl, '%2b')}+{cnt(rl, '%252b')}>=2)")


def _benign_address(raw: str, rl: str) -> str:
    veto = [f"contains({rl},'%00')", f"rx({raw},NUL)", "contains(low,'%00')", "rx(low,NUL)", f"rx({raw},FULLWIDTH)", "rx(low,FULLWIDTH)",
            f"contains({rl},'%ef%bc')", f"contains({rl},'%ef%bd')", "contains(low,'%ef%bc')", "contains(low,'%ef%bd')",
            f"rx({raw},UNICODE_ESCAPE)", "rx(low,UNICODE_ESCAPE)", f"contains({raw},'|')", "contains(low,'|')", f"contains({rl},'%7c')", "contains(low,'%7c')",
            f"rx({rl},CRLF)", f"contains({rl},'set-cookie')", f"rx({raw},CONCAT_SPLIT)", "rx(low,CONCAT_SPLIT)", f"contains({rl},'%27%2b%27')", "contains(low,'%27%2b%27')",
            f"pp_{rl}", f"rx({rl},PRODUCT_TAIL)", "length(addr)<4", "length(addr)>400", "rx(addr,ADDRESS_VETO)", "anyof(addr,ADDR_WORDS)"]
    name = "(length(addr)<=48 AND (rx(addr_name,NAME_TOKEN) OR rx(addr,NAME_LOOSE)) AND NOT rx(addr,FORM_INJ) AND nrx(addr,LETTER)>=4)"
    safe = f"((rx(addr,ADDRESS_SAFE) OR rx(addr_np,ADDRESS_SAFE)) AND NOT rx(addr,FORM_INJ) AND (contains(addr,' ') OR contains({raw},'+') OR contains({rl},'%2b')) AND nrx(addr,LETTER)>=6)"
    return f"NOT ({' OR '.join(veto)}) AND (rx(addr,STREET) OR {name} OR {safe})"


def _benign_context(raw: str, rl: str) -> str:
    veto = [f"rx({raw},FULLWIDTH)", "rx(low,FULLWIDTH)", f"nrx({raw},UNICODE_ESCAPE)>=2", f"contains({rl},'%00')", f"rx({raw},NUL)", f"contains({raw},'|')",
            f"contains({rl},'%7c')", f"an_{rl}", f"rx({raw},CONCAT_SPLIT)", f"contains({rl},'%27%2b%27')", f"rx({rl},CRLF_COOKIE)", f"rx({rl},COOKIE_COLON)"]
    return f"(bform_{rl} OR baddr_{rl}) AND NOT ({' OR '.join(veto)})"


def term(*pairs: tuple[str, float]) -> str:
    return "+".join(f"CASE WHEN {c} THEN {w}D ELSE 0D END" for c, w in pairs) or "0D"


def top(*pairs: tuple[str, float]) -> str:
    return "greatest(0D," + ",".join(f"CASE WHEN {c} THEN {w}D ELSE 0D END" for c, w in pairs) + ")"


def cascade(rows: list[tuple[str, str, str]]) -> tuple[str, str]:
    """(label, confidence) expressions of an ordered rule list; first match wins."""
    lab = "CASE " + " ".join(f"WHEN {c} THEN {lab}" for c, lab, _ in rows) + " END"
    conf = "CASE " + " ".join(f"WHEN {c} THEN {conf}" for c, _, conf in rows) + " END"
    return lab, conf


# --- stages --------------------------------------------------------------------------------
# Input columns: raw, norm, depth and the text views raw_low, low, klow (folded), folded, dform
# (plus-decoded), uraw / ulow (escape-decoded), xm/xd and xl/xld (XML canonical and deep views),
# addr / addr_name / addr_np / low_sp / raw_low_pp / low_pp (address views), mbody, reasm, b64,
# inner, dup_raw_low / dup_low (repeated names), hient_any.

SIGNALS = [
    ("obf", "rx(raw,NUL) OR anyof(raw_low,OBF) OR rx(raw_low,SCI_NOTATION) OR rx(raw,FULLWIDTH)"),
    ("fw", "rx(raw,FULLWIDTH)"), ("fwn", "rx(raw,FULLWIDTH) OR rx(low,FULLWIDTH)"),
    ("pct", "length(raw)-length(replace(raw,'%',''))"), ("pctl", "length(low)-length(replace(low,'%',''))"),
    ("esc", "nrx(raw,UNICODE_ESCAPE)"), ("casep", "rx(raw,PARAM_MIXED)"),
    ("cmd_raw_low", "anyof(raw_low,ENC_CMD)"), ("cmd_low", "anyof(low,ENC_CMD)"), ("cmd_klow", "anyof(klow,ENC_CMD)"), ("cmd_dform", "anyof(dform,ENC_CMD)"),
    ("an_raw_low", "rx(raw_low,ANOMALY_FIELDS)"), ("an_low", "rx(low,ANOMALY_FIELDS)"), ("an_dform", "rx(dform,ANOMALY_FIELDS)"),
    ("sq_raw_low", "rx(raw_low,SQLI_MARK)"), ("sq_low", "rx(low,SQLI_MARK)"), ("sq_dform", "rx(dform,SQLI_MARK)"),
    ("finj_raw_low", "rx(raw_low,FORM_INJ)"), ("finj_low", "rx(low,FORM_INJ)"), ("finj_dform", "rx(dform,FORM_INJ)"),
    ("fctx_raw_low", "rx(raw_low,FORM_CTX)"), ("fctx_low", "rx(low,FORM_CTX)"), ("fctx_dform", "rx(dform,FORM_CTX)"),
    ("bool_like", "rx(raw_low,BOOL_LIKE) OR rx(low,BOOL_LIKE)"),
    ("nullval", "rx(raw_low,NULL_IN_VALUE)"), ("nul_any", "contains(raw_low,'%00') OR rx(raw,NUL)"), ("nsplice", "rx(raw,NULL_SPLICE)"),
    ("uni_sig", "(nrx(raw,UNICODE_ESCAPE)>=2 AND anyof(uraw,UNI_WORDS)) OR anyof(raw_low,UNI_FIXED) OR (nrx(low,UNICODE_ESCAPE)>=2 AND anyof(ulow,UNI_WORDS)) OR anyof(low,UNI_FIXED)"),
    ("uni_low", "(nrx(low,UNICODE_ESCAPE)>=2 AND anyof(ulow,UNI_WORDS)) OR anyof(low,UNI_FIXED)"),
    ("hexw", "rx(raw,HEX32_WHOLE)"), ("hexmix", "rx(raw,HEX32_WHOLE) AND rx(raw,HAS_UPPER_HEX) AND rx(raw,HAS_LOWER_HEX)"),
    ("webkit", "contains(raw_low,'webkitformboundary')"),
    ("atobx", "rx(raw_low,EVAL_ATOB)"),
    ("xxe", _xxe("xm", "xd")), ("xxel", _xxe("xl", "xld")),
    ("entity_xss", "rx(raw,HTML_ENTITY_XSS) OR (contains(raw,'&#') AND (("
                   + cnt("raw_low", "&#") + ">=4 AND anyof(raw_low,ENTITY_WORDS)) OR (" + cnt("raw_low", "&#") + ">=5 AND anyof(raw_low,ENTITY_STRONG))"
                   " OR rx(raw_low,ENTITY_BROKEN) OR contains(raw_low,'onerror') OR contains(raw_low,'&&#35;')))"),
]
SIGNALS2 = [
    ("strong", _strong("raw_low", "pct")), ("strong_low", _strong("low", "pctl")),
    ("pp_raw_low", _pct_plus("raw_low")), ("pp_low", _pct_plus("low")),
]
SIGNALS3 = [
    ("bform_raw_low", _benign_form("raw", "raw_low", "strong")), ("bform_low", _benign_form("low", "low", "strong_low")),
    ("baddr_raw_low", _benign_address("raw", "raw_low")), ("baddr_low", _benign_address("low", "low")),
]
SIGNALS4 = [("bctx", _benign_context("raw", "raw_low")), ("bctx_low", _benign_context("low", "low"))]

KEYWORD = [(f"k_{k}", f"0.35D*nof(klow,KW_{k})" + {
    "SQLi": "+" + term(("contains(klow,'union') AND contains(klow,'select')", .4), ("uni_low", .35), ("rx(klow,NULL_IN_VALUE)", .35)),
    "CMD": "+" + term(("cmd_klow", .35)),
    "XXE": "+CASE WHEN xxel>=0.40 THEN 0.45D+xxel*0.4D ELSE 0D END"}.get(k, "")) for k in ATTACKS]
KEYWORD2 = [("kx_Normal", "0.05D")] + [(f"kx_{k}", {
    "PathTraversal": "k_PathTraversal*CASE WHEN xxel>=0.40 THEN 0.4D ELSE 1D END",
    "SQLi": "k_SQLi*CASE WHEN xxel>=0.40 THEN 0.7D ELSE 1D END"}.get(k, f"k_{k}")) for k in ATTACKS]
# Score map of a benign context.
_BENIGN_KW = {"Normal": .92, "SQLi": .02, "XSS": .02, "CMD": .01, "PathTraversal": .01, "FileInclusion": .01, "XXE": .005, "PromptInjection": .005}
KEYWORD3 = [(n, f"CASE WHEN bctx_low THEN {_BENIGN_KW[n[3:]]}D ELSE {e} END") for n, e in scaled("kw", "kx")]
KEYWORD4 = [("kw_peak", peak("kw")), ("kw_best", best("kw"))]

_FORMISH = "(finj_low OR fctx_low OR depth>=1)"
EVASION = [
    ("ev_SQLi", top(
        ("rx(raw_low,DOUBLE_PCT) AND NOT (rx(raw_low,DOUBLE_CMD) OR cmd_raw_low) AND rx(raw_low,DOUBLE_QUOTE_SLASH)", .40),
        (f"(nullval OR contains(raw_low,'%00')) AND {_FORMISH}", .55),
        (f"(nullval OR contains(raw_low,'%00')) AND NOT {_FORMISH} AND rx(raw_low,NULL_BETWEEN)", .42),
        ("atobx AND anyof(low,ATOB_WORDS)", .62), ("atobx AND depth>=1", .48),
        ("webkit AND anyof(low,SQL_PHRASES)", .72), ("uni_sig", .55),
        ("(webkit OR contains(raw_low,'boundary*0=')) AND (rx(mbody,HEX32_TOKEN) OR cmd_raw_low OR contains(low,'str='))", .65),
        ("kw_peak>=0.12 AND rx(low,WEAK_SQLI)", .35))),
    ("ev_XSS", top(("atobx AND anyof(low,ATOB_WORDS)", .45))),
    ("ev_CMD", top(
        ("rx(raw_low,DOUBLE_PCT) AND (rx(raw_low,DOUBLE_CMD) OR cmd_raw_low)", .60),
        (f"(nullval OR contains(raw_low,'%00')) AND {_FORMISH}", .40),
        ("(webkit OR contains(raw_low,'boundary*0=')) AND (rx(mbody,HEX32_TOKEN) OR cmd_raw_low OR contains(low,'str='))", .65),
        ("kw_peak>=0.12 AND rx(low,WEAK_CMD)", .35))),
    ("ev_XXE", top(("webkit AND (rx(raw,DOCTYPE) OR rx(raw,HEX_SYSTEM) OR rx(raw,HEX_PCT_ENTITY))", .75))),
    ("ev_PathTraversal", "0D"), ("ev_FileInclusion", "0D"), ("ev_PromptInjection", "0D"),
]
EVASION2 = [("ev_peak", peak("ev")), ("ev_best", best("ev"))]

STRUCTURE = [
    ("t_SQLi", term(
        ("fwn", .45), ("esc>=2", .40), ("dup_raw_low", .55), ("dup_raw_low AND hient_any", .35),
        ("(rx(raw,HEX32_PARAM) OR rx(low,HEX32_PARAM)) AND (dup_raw_low OR depth>=1 OR kw_peak>=0.2 OR obf)", .5),
        ("hexw AND (dup_raw_low OR rx(raw_low,BOOL_LIKE))", .45), ("finj_low AND (contains(low,'''') OR contains(raw_low,'%27'))", .6),
        ("bool_like", .55),
        ("contains(raw_low,'atob(') AND (depth>=1 OR anyof(low,ATOB_SCRIPT)) AND kw_peak>=0.15", .25),
        ("fw AND finj_low", .4), ("contains(raw_low,'eval(') AND finj_low", .45),
        ("nullval AND (finj_low OR depth>=1 OR cmd_raw_low)", .45), ("uni_sig", .55))),
    ("t_XSS", term(
        ("rx(raw,SCRIPT_SPLIT) AND anyof(low,SCRIPT_PIECES)", .75), ("webkit AND anyof(low,SCRIPT_MULTI)", .75),
        ("contains(raw_low,'atob(') AND (depth>=1 OR anyof(low,ATOB_SCRIPT))", .45),
        ("contains(raw_low,'data:text/html') OR contains(raw_low,'ontoggle=')", .55))),
    ("t_CMD", term(
        ("anyof(raw_low,ECHO3)", .55), ("contains(raw_low,'sleep') AND anyof(raw_low,SLEEP_TEST)", .50), ("anyof(raw_low,STR_ECHO)", .45),
        ("cmd_raw_low", .55), ("contains(raw_low,'%252') AND cmd_raw_low", .15), ("nullval AND cmd_raw_low", .35),
        ("anyof(raw_low,SHELL_BLANK)", .5),
        ("webkit AND (cmd_raw_low OR anyof(raw_low,MULTI_CMD))", .55))),
    ("t_FileInclusion", term(("anyof(raw_low,WRAPPERS)", .65))),
    ("t_PathTraversal", term(
        ("contains(raw_low,'%c0%af') OR contains(raw_low,'..;/') OR contains(raw_low,'%u2215')", .55), ("rx(raw_low,OVERLONG_DOTS)", .45),
        ("contains(raw_low,'%c0%af') AND (contains(raw_low,'etc') OR contains(raw_low,'pas'))", .35))),
    ("t_PromptInjection", term(
        ("contains(raw_low,'[system]') OR contains(raw_low,'validation: approved')", .45), ("rx(raw,ZERO_WIDTH) AND (kw_peak>=0.15 OR finj_low)", .35))),
    ("t_XXE", "CASE WHEN xxe>=0.45 THEN 0.55D+xxe*0.35D ELSE 0D END"),
    ("zw_sql", term(("rx(raw,ZERO_WIDTH) AND (kw_peak>=0.15 OR finj_low)", .2), ("webkit AND mbody<>raw AND rx(mbody,HEX32_TOKEN)", .6))),
]
STRUCTURE2 = [("tx_Normal", "0.05D")] + [(f"tx_{k}", {
    "SQLi": "greatest(t_SQLi*CASE WHEN xxe>=0.45 THEN 0.65D ELSE 1D END+zw_sql, ev_SQLi)",
    "PathTraversal": "greatest(t_PathTraversal*CASE WHEN xxe>=0.45 THEN 0.35D ELSE 1D END, ev_PathTraversal)",
}.get(k, f"greatest(t_{k},ev_{k})")) for k in ATTACKS] + [("st_flat", "bctx AND NOT (fwn OR esc>=2 OR contains(raw_low,'%00'))")]
# A benign context scores .92 against .01 per class, normalised to sum 1.
STRUCTURE3 = [(n, f"CASE WHEN st_flat THEN {0.92 if n == 'st_Normal' else 0.01}D/0.99D ELSE {e} END") for n, e in scaled("st", "tx")]
STRUCTURE4 = [("st_peak", peak("st")), ("st_best", best("st"))]

PRIOR = [
    ("p_Normal", "0.1D"),
    ("p_SQLi", term(("anyof(low,PRIOR_SQL)", .7), ("contains(low,'union') AND contains(low,'select')", .5), ("anyof(low,PRIOR_COMMENT)", .35),
                    ("contains(low,'boundary=') OR contains(low,'content-disposition')", .2),
                    (f"{cnt('low', '=')}>=3 AND {cnt('low', '&')}>=2 AND anyof(low,PRIOR_PAIRS)", .15),
                    ("strong AND depth>=1", .2), ("contains(raw_low,'%00') OR contains(raw_low,'atob(')", .45)) + "+0.1D*nof(low,SQL_WORDS)"),
    ("p_XSS", term(("anyof(low,PRIOR_XSS)", .7), ("anyof(low,PRIOR_XSS_ENC)", .4), ("contains(low,'boundary=') OR contains(low,'content-disposition')", .25),
                   ("strong AND depth>=1", .15), ("webkit OR contains(raw_low,'content-disposition')", .3)) + "+0.1D*nof(low,XSS_WORDS)"),
    ("p_CMD", term(("anyof(low,PRIOR_CMD)", .5), ("contains(raw_low,'%00') OR contains(raw_low,'atob(')", .35),
                   ("webkit OR contains(raw_low,'content-disposition')", .5), ("anyof(raw_low,ECHO3)", .55))),
    ("p_PathTraversal", term(("anyof(low,PRIOR_PATH)", .6))), ("p_FileInclusion", term(("anyof(low,PRIOR_FILE)", .6))),
    ("p_XXE", term(("anyof(low,PRIOR_XXE)", .7))), ("p_PromptInjection", term(("anyof(low,PRIOR_PROMPT)", .7))),
]
PRIOR2 = [("px_Normal", "p_Normal+0.3D*st_Normal+CASE WHEN bctx THEN 0.70D WHEN bform_raw_low THEN 0.35D ELSE 0D END")] + [
    (f"px_{k}", f"(p_{k}+CASE WHEN depth>=2 THEN 0.25D*kw_{k} ELSE 0D END+0.3D*st_{k})"
     + ("*CASE WHEN bctx THEN 0.22D" + (" WHEN bform_raw_low THEN 0.5D" if k != "CMD" else "") + " ELSE 1D END" if k in ("SQLi", "XSS", "CMD") else ""))
    for k in ATTACKS]
PRIOR3 = scaled("rp", "px")
PRIOR4 = [("rp_peak", peak("rp")), ("rp_best", best("rp"))]

SEMANTIC = [
    ("sem_Normal", "0.05D"), ("sem_SQLi", term(("contains(low,'union') AND contains(low,'select')", .4))),
    ("sem_XSS", term(("contains(low,'<script') OR contains(low,'onerror')", .4))), ("sem_CMD", "0D"), ("sem_PathTraversal", "0D"), ("sem_FileInclusion", "0D"),
    ("sem_XXE", term(("contains(low,'<!entity') OR contains(low,'&xxe')", .5))), ("sem_PromptInjection", term(("anyof(low,SEM_PROMPT)", .5))),
]

SCORE_STAGES = [SIGNALS, SIGNALS2, SIGNALS3, SIGNALS4, KEYWORD, KEYWORD2, KEYWORD3, KEYWORD4, EVASION, EVASION2,
                STRUCTURE, STRUCTURE2, STRUCTURE3, STRUCTURE4, PRIOR, PRIOR2, PRIOR3, PRIOR4, SEMANTIC]

# --- cascades ---------------------------------------------------------------------------------
XXE_RULES = [
    ("xxe>=0.55", "'XXE'", "greatest(0.78D,xxe)"),
    ("rx(xd,DOCTYPE) AND rx(xd,ENTITY) AND (rx(xd,FILE_URI) OR rx(xm,HEX_FILE) OR rx(xd,LOCAL_DTD))", "'XXE'", "0.90D"),
    ("(rx(raw,PARAM_ENTITY) OR rx(low,PARAM_ENTITY)) AND (rx(raw,FILE_URI) OR rx(low,FILE_URI) OR rx(xd,FILE_URI) OR rx(xm,HEX_FILE))", "'XXE'", "0.86D"),
    ("rx(xm,HEX_PCT_ENTITY) AND rx(xd,DOCTYPE)", "'XXE'", "0.84D"),
    ("contains(lower(xm),'<!doctype') AND contains(lower(xm),'<!entity') AND contains(lower(xm),'file://')", "'XXE'", "0.88D"),
]
CONCAT_RULES = [
    ("rx(raw,CONCAT_SPLIT) AND rk_peak>=0.15", "rk_best", "greatest(rk_peak,0.62D)"),
    ("rx(raw,CONCAT_SPLIT) AND anyof(reasm,CONCAT_WORDS)", "'SQLi'", "0.60D"),
]
ATOB_RULES = [
    ("atobx AND b64='' AND (cmd_raw_low OR anyof(raw_low,ATOB_NO_B64))", "'CMD'", "0.62D"),
    ("atobx AND b64=''", "'SQLi'", "0.60D"),
    ("atobx AND (anyof(blob,ATOB_CMD) OR anyof(blob,ENC_CMD))", "'CMD'", "0.76D"),
    ("atobx AND anyof(b64u,ATOB_SQL)", "'SQLi'", "0.74D"),
    ("atobx AND anyof(b64u,ATOB_FORM)", "'SQLi'", "0.68D"),
    ("atobx AND anyof(raw_low,ATOB_PIPE)", "'CMD'", "0.68D"),
    ("atobx", "'SQLi'", "0.62D"),
]
# keyword scores of the reassembled text (short form: no benign context, no XML terms)
REASM = [(f"r_{k}", f"0.35D*nof(reasm,KW_{k})" + ("+" + term(("contains(reasm,'union') AND contains(reasm,'select')", .4)) if k == "SQLi" else "")) for k in ATTACKS]
REASM2 = [("r_Normal", "0.05D")]
REASM3 = scaled("rk", "r")
REASM4 = [("rk_peak", peak("rk")), ("rk_best", best("rk"))]
_X = cascade(XXE_RULES)
_C = cascade(CONCAT_RULES)
_A = cascade(ATOB_RULES)
SPECIAL = [("xxe_label", _X[0]), ("xxe_conf", _X[1]), ("concat_label", _C[0]), ("concat_conf", _C[1]), ("atob_label", _A[0]), ("atob_conf", _A[1])]

_SHELL_NUL = "nul_any AND (cmd_raw_low OR rx(raw_low,SHELL_ECHO) OR anyof(raw_low,NUL_SHELL))"
_FORM_ANY = ("(finj_raw_low OR fctx_raw_low OR rx(raw_low,BENIGN_FORM) OR rx(raw_low,BENIGN_SHOP) OR finj_dform OR fctx_dform"
             " OR rx(dform,BENIGN_FORM) OR rx(dform,BENIGN_SHOP) OR finj_low OR fctx_low)")
_POLLUTED = f"(an_raw_low OR an_low OR an_dform OR contains(dform,'|')) AND {_FORM_ANY}"
_FORM_DEC = "(finj_low OR fctx_low OR finj_dform OR fctx_dform)"
_FULL_ENC = "(rx(raw_low,FULL_ENC_FORM) OR (pct>=4 AND contains(raw_low,'%3d') AND contains(raw_low,'%26')))"
_INJ = "(sq_raw_low OR contains(raw,'''') OR contains(raw_low,'%27') OR contains(raw_low,'%2527') OR rx(raw_low,NULL_SPLICE))"
_ODD_FORM = ("(sq_dform OR contains(dform,'|') OR right(rtrim(dform),1)='/' OR rx(dform,FIELD_SUFFIX) OR rx(dform,QTY_ODD)"
             " OR contains(right(raw_low,6),'%20') OR right(rtrim(raw_low),3)='%2f' OR contains(dform,','))")
_ENC_HITS = f"({cnt('raw_low', '%2b')}+{cnt('raw_low', '%252b')}+{cnt('raw_low', '%20')}+{cnt('raw_low', '%2520')})"
_LONE = "NOT contains(raw,'=') AND NOT contains(raw,'&') AND obf"
_PLAIN_ADDR = "(low<>'' AND NOT contains(low,'%') AND baddr_low)"
RESCUE_GATE = ("raw<>'' AND (obf OR rx(raw,BOOL_LIKE) OR hexmix OR (esc>=2 AND rx(uraw,HEX32_WHOLE)) OR (dup_raw_low AND rx(raw,HEX32_VALUE))"
               " OR rx(raw,FULL_ENC_FORM) OR casep OR rx(raw,JSON_NESTED) OR entity_xss OR rx(raw,OPAQUE_URL) OR rx(raw,DYNAMIC_MARK) OR xxe>=0.45)")
# Ordered rescue branches (condition, label, confidence).  Branches that only match strings of one
# data set belong to the user's rule table and run through the dynamic-rule join.
RESCUE_RULES = [
    ("xxe_label IS NOT NULL", "xxe_label", "xxe_conf"),
    (f"{_POLLUTED} AND (cmd_raw_low OR cmd_dform OR anyof(raw_low,CMD_HINT))", "'CMD'", "0.68D"),
    (_POLLUTED, "'SQLi'", "0.66D"),
    ("concat_label IS NOT NULL", "concat_label", "concat_conf"),
    ("rx(raw,CONCAT_SPLIT) OR contains(raw_low,'%27%2b%27')", "'SQLi'", "0.58D"),
    ("bool_like", "'SQLi'", "0.74D"),
    ("rx(raw_low,CRLF_COOKIE) OR rx(raw_low,COOKIE_TAMPER)", "'SQLi'", "0.72D"),
    ("hexmix", "'SQLi'", "0.65D"),
    ("NOT contains(raw,'&') AND rx(raw,HEX32_VALUE) AND rx(raw,HAS_UPPER_HEX) AND rx(raw,HAS_LOWER_HEX) AND (finj_raw_low OR fctx_raw_low)", "'SQLi'", "0.65D"),
    ("esc>=2 AND rx(uraw,HEX32_WHOLE)", "'SQLi'", "0.66D"),
    ("dup_raw_low AND (contains(raw_low,'<script') OR contains(raw_low,'alert('))", "'XSS'", "0.70D"),
    ("dup_raw_low AND anyof(raw_low,HPP_WORDS)", "'SQLi'", "0.70D"),
    ("dup_raw_low AND rx(raw,HEX32_VALUE)", "'SQLi'", "0.64D"),
    ("dup_raw_low AND hient_any", "'SQLi'", "0.72D"),
    (_SHELL_NUL, "'CMD'", "0.78D"),
    ("nsplice", "'SQLi'", "0.72D"),
    ("nul_any AND (finj_raw_low OR fctx_low)", "'SQLi'", "0.78D"),
    ("rx(raw_low,SHELL_ECHO) OR rx(folded,SHELL_ECHO)", "'CMD'", "0.75D"),
    ("folded<>raw_low AND rx(folded,ECHO)", "'CMD'", "0.72D"),
    ("webkit AND (cmd_raw_low OR rx(raw,HEX32_TOKEN))", "'CMD'", "0.70D"),
    ("webkit", "'SQLi'", "0.62D"),
    ("atob_label IS NOT NULL", "atob_label", "atob_conf"),
    ("contains(raw_low,'eval(atob') AND depth>=1", "'SQLi'", "0.68D"),
    ("(rx(raw_low,OPAQUE_URL) OR rx(low,OPAQUE_URL)) AND (contains(raw_low,' or ') OR contains(raw_low,'%27%20or%20'))", "'SQLi'", "0.66D"),
    ("rx(raw_low,OPAQUE_URL) OR rx(low,OPAQUE_URL)", "'CMD'", "0.62D"),
    ("pct>=6 AND pct/greatest(length(raw_low),1)>=0.28 AND NOT sq_raw_low AND NOT bform_raw_low AND NOT anyof(raw_low,FORM_NAMES)", "'CMD'", "0.62D"),
    ("(rx(raw_low,DYNAMIC_MARK) OR rx(low,DYNAMIC_MARK)) AND (contains(raw_low,'/etc/passwd') OR contains(raw_low,'%252e') OR contains(low,'/etc/passwd'))", "'PathTraversal'", "0.70D"),
    ("(rx(raw_low,DYNAMIC_MARK) OR rx(low,DYNAMIC_MARK)) AND (contains(raw_low,'passw%68') OR contains(raw_low,'logina='))", "'CMD'", "0.62D"),
    ("rx(raw_low,DYNAMIC_MARK) OR rx(low,DYNAMIC_MARK)", "'SQLi'", "0.66D"),
    ("rx(raw_low,MAIL_DOUBLE)", "'SQLi'", "0.57D"),
    ("contains(raw_low,'%25ef%25bf%25bd')", "'SQLi'", "0.57D"),
    ("contains(raw_low,'%ef%bf%bd') AND depth>=1 AND sq_raw_low AND NOT baddr_raw_low", "'SQLi'", "0.57D"),
    ("(finj_low OR fctx_low) AND (an_raw_low OR an_low)", "'SQLi'", "0.56D"),
    (f"{_FULL_ENC} AND (an_raw_low OR an_dform) AND (cmd_raw_low OR cmd_dform)", "'CMD'", "0.66D"),
    (f"{_FULL_ENC} AND (an_raw_low OR an_dform)", "'SQLi'", "0.66D"),
    (f"{_FULL_ENC} AND (finj_dform OR fctx_dform OR contains(dform,'precio=')) AND {_ODD_FORM} AND (cmd_raw_low OR cmd_dform)", "'CMD'", "0.64D"),
    (f"{_FULL_ENC} AND (finj_dform OR fctx_dform OR contains(dform,'precio=')) AND {_ODD_FORM}", "'SQLi'", "0.64D"),
    (f"{_FULL_ENC} AND (finj_dform OR fctx_dform) AND NOT contains(raw,'=') AND (rx(dform,PWD_ODD) OR contains(dform,'remember=on/'))", "'SQLi'", "0.60D"),
    ("pct>=2 AND (contains(raw_low,'%3d') OR contains(raw_low,'%26')) AND (an_raw_low OR an_low)", "'SQLi'", "0.62D"),
    (f"pct>=2 AND (contains(raw_low,'%3d') OR contains(raw_low,'%26')) AND {_FORM_DEC} AND ({_INJ} OR sq_low OR contains(dform,'|'))", "'SQLi'", "0.55D"),
    ("pct>=2 AND rx(raw_low,ENC_NAME) AND kw_peak>=0.10", "'SQLi'", "0.58D"),
    ("pct>=2 AND rx(raw_low,ENC_NAME) AND (an_raw_low OR an_dform)", "'SQLi'", "0.60D"),
    (f"pct>=2 AND rx(raw_low,ENC_NAME) AND {_FORM_DEC} AND {_INJ}", "'SQLi'", "0.55D"),
    (f"{_LONE} AND (pp_raw_low OR (rx(raw_low,PRODUCT_TAIL) AND (contains(low,'%2b') OR contains(raw_low,'%252b'))) OR nul_any)", "'SQLi'", "0.74D"),
    (f"{_LONE} AND ({_ENC_HITS}>=2 OR contains(raw_low,'%252') OR {cnt('raw_low', '%25')}>=2) AND NOT baddr_raw_low AND NOT {_PLAIN_ADDR}", "'SQLi'", "0.74D"),
    (f"{_LONE} AND {_ENC_HITS}>=1 AND length(trim(raw)) BETWEEN 4 AND 96 AND NOT baddr_raw_low AND NOT {_PLAIN_ADDR}", "'SQLi'", "0.73D"),
    ("esc>=2 AND NOT baddr_raw_low", "'SQLi'", "0.73D"),
    ("esc>=1 AND (contains(uraw,'|') OR contains(uraw,'?') OR rx(uraw,ANOMALY_FIELDS) OR rx(uraw,FORM_INJ) OR rx(uraw,SQLI_MARK) OR rx(uraw,ID_PARAM))", "'SQLi'", "0.74D"),
    ("fw AND (contains(folded,'|') OR contains(folded,'?') OR rx(folded,ANOMALY_FIELDS) OR rx(folded,FORM_INJ) OR rx(folded,ID_PARAM) OR rx(folded,STREET)"
     " OR rx(folded,NAME_TOKEN) OR (length(trim(raw)) BETWEEN 4 AND 96 AND NOT contains(raw,'=') AND NOT contains(raw,'&')))", "'SQLi'", "0.74D"),
    ("contains(raw,'/**/') AND (rx(nocomment,BENIGN_FORM) OR rx(nocomment,FORM_CTX) OR rx(raw_low,COMMENT_PARAM))", "'SQLi'", "0.66D"),
    ("casep AND (an_raw_low OR an_low OR contains(raw,'|') OR contains(raw_low,'%7c') OR rx(raw_low,CASE_QTY) OR rx(raw_low,CASE_ADDR))", "'SQLi'", "0.63D"),
    ("rx(raw,JSON_NESTED) AND (rx(inner_low,ANOMALY_FIELDS) OR rx(inner_low,SQLI_MARK) OR contains(inner_low,'|') OR contains(inner_low,'%3f')"
     " OR contains(inner_low,'%00') OR rx(inner_low,VALUE_TAIL_BLANK) OR (length(trim(inner_low))<=8 AND contains(inner_low,'%')))", "'SQLi'", "0.66D"),
    ("entity_xss", "'XSS'", "0.70D"),
    ("strong AND depth>=1 AND kw_peak>=0.12", "kw_best", "greatest(kw_peak,0.55D)"),
]
_R = cascade(RESCUE_RULES)
RESCUE = [("rescue_label", f"CASE WHEN {RESCUE_GATE} THEN {_R[0]} END"), ("rescue_conf", f"CASE WHEN {RESCUE_GATE} THEN {_R[1]} END")]

VIEW_RULES = {
    "SQLi": term(("rx(vl,VIEW_SQL)", .70), ("anyof(vl,VIEW_SQL2)", .40)),
    "XSS": term(("anyof(vl,VIEW_XSS)", .75), ("rx(vl,VIEW_ENTITY) AND anyof(vl,VIEW_XSS2)", .45)),
    "CMD": term(("anyof(vl,VIEW_CMD)", .70), ("contains(vl,'sleep') AND anyof(vl,VIEW_CMD2)", .50)),
    "PathTraversal": term(("anyof(vl,VIEW_PATH)", .70)), "FileInclusion": term(("anyof(vl,VIEW_FILE)", .70)),
    "XXE": term(("anyof(vl,VIEW_XXE)", .75)), "PromptInjection": term(("anyof(vl,VIEW_PROMPT)", .65)),
}


def needed(wanted: list[str], stages: list[list[tuple[str, str]]]) -> list[list[tuple[str, str]]]:
    """Only the definitions that the wanted columns depend on."""
    names = {n for st in stages for n, _ in st}
    keep = set(wanted)
    out = []
    for st in reversed(stages):
        kept = [(n, e) for n, e in st if n in keep]
        for _, e in kept:
            keep |= names & set(re.findall(r"\w+", e))
        out.append(kept)
    return [st for st in reversed(out) if st]
