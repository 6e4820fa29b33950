"""Regular expressions of the detectors, in Java's dialect.

`(?U-u)` makes \\d, \\w, \\s and \\b follow Unicode on every Java release, and
leaves ignore-case matching to the ASCII letters. A look at the first character,
spaces that never has to give anything back is possessive, so that a line of
spaces takes linear time. Neither changes what is matched.
"""

from __future__ import annotations

import re

from maskloom.functions.matching import MARK

# --- Fixed values: what each detector matches --------------------------------
API_KEY = r"(?iU-u)\b((?:x-)?api-key\s*+[:=]\s*+)([A-Za-z0-9]+)"
BEARER = r"(?iU-u)\bBearer\s+[A-Za-z0-9\-\._~\+\/]+=*"
# The loop takes a group only when the address goes on behind it, and so never
# has to give one back. No address is too long for it.
IPV6 = (r"(?=[A-Fa-f0-9])(?:(?:[A-Fa-f0-9]{1,4}:(?=[A-Fa-f0-9:])){2,}+(?:[A-Fa-f0-9]{1,4}|:)"
        r"|[Ff][Ee]80::[A-Fa-f0-9:%]+)")
CLOCK_TIME = r"(?U-u)^\d{2}:\d{2}:\d{2}$"
SITE_PATH = r"(?i)(?=[S])(SMS_|site_)([a-zA-Z0-9]{3})"
LDAP_DOMAIN = r"(?i)DC=[a-zA-Z0-9-]+"
KEY_VALUE = (r"(?iU-u)"
             r"(SiteCode|Site|DatabaseName|Database|Catalog|SQLServerName|Server|Source)"
             r"(\s*+\]?\s*+[:=]\s*+)([\"'\[]?)([^\"'\s\],;]+)([\"'\]]?)")
URL = r"(?iU-u)\b(https?|ftp)://([a-zA-Z0-9\.-]+)(:[0-9]+)?(/[^ \t\r\n]*)?"
CONNECTION_PAIR = (r"(?iU-u)"
                   r"(Data Source|Server|Initial Catalog|Database|User ID|Password)\s*+=\s*([^;]+)")
EMAIL = r"(?U-u)\b[A-Za-z0-9._%+-]++@(?!\.)[A-Za-z0-9.-]+(?:\.[A-Za-z]{2,})?\b"
TR_MOBILE = (r"(?U-u)(?<![A-Za-z0-9])(?:\+90|0)\s*5\d{2}[\s\.\-]?\d{3}"
             r"[\s\.\-]?\d{2}[\s\.\-]?\d{2}\b")
PHONE = (r"(?U-u)(?=[+(\d])(?<![A-Za-z0-9])(?:\+|00)?(?:\d{1,3}[\s\.\-])?"
         r"(?:\(?\d{3}\)?[\s\.\-]\d{3}[\s\.\-]\d{4}"
         r"|\(?\d{3}\)?[\s\.\-]\d{3}[\s\.\-]\d{2}[\s\.\-]\d{2})(?![A-Za-z0-9])")
CARD = r"(?U-u)\b(?:\d{4}[- ]?){3}\d{4}\b"
LDAP_NAME = r"(?iU-u)\b(CN|OU|DC)=([^,]+)"
IPV4 = (r"(?U-u)(?=[0-9])(?<!\.)\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b(?!\.)")
SSN = r"(?U-u)\b\d{3}-\d{2}-\d{4}\b"
IBAN = r"(?U-u)\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b"
THUMBPRINT = r"(?U-u)\b[0-9a-fA-F]{40}\b"
CONNECTION_SECRET = r"(?i)(?<=(?:Password|Pwd|User ID|Uid)=)[^;]*"
DOMAIN_USER = r"(?U-u)\b[a-zA-Z0-9-]{2,15}\\{1,2}[a-zA-Z0-9._-]{2,30}\b"
USERNAME = (r"(?U-u)(?<=\s|^|\"|'|\\)[a-zA-Z0-9-]{2,15}\\[a-zA-Z0-9._-]{2,30}"
            r"(?=\s|$|\"|'|\\|\])")
HOSTNAME = r"(?U-u)\b[a-zA-Z0-9-]*(?i:SW|SRV|SERVER)[a-zA-Z0-9-]*\b"
# A label and its dot can be matched in one way only and none is given back, which keeps Java's stack flat however
# many there are. So a match may go on behind its last top-level name; it ends there, see FQDN_END.
FQDN = (r"(?U-u)\b(?!\d+\.\d+\.\d+\.\d+)"
        r"(?:[a-zA-Z0-9][a-zA-Z0-9-]{0,62}+(?<!-)\.)++"
        r"(?:(?!(?i:zip|exe|dll|log|txt|png|core)\b)[a-zA-Z]{2,63}\b)?+")
# Behind a top-level name inside such a match stands a dot, a hyphen, or the match's end.
FQDN_END = rf"\.(?!(?i:zip|exe|dll|log|txt|png|core)(?:[.-]|{MARK}))[a-zA-Z]{{2,63}}(?=[.-]|{MARK})"
IPV6_TAIL = r"(?<=\[IP6-[0-9A-F]{6}\])(?:%[0-9A-Za-z]+|:[0-9]+)"

# Constants some detectors write in place of a token.
SCRUBBED_TERM = "[DOMAIN-LC]"
SCRUBBED_DOMAIN = "DC=[DOMAIN]"
SCRUBBED_SITE = "[SITE-CODE]"
# -----------------------------------------------------------------------------

BLANK = r"(?U)\A\s*\z"
JSON_OBJECT_SHAPE = r"(?U)\A\s*\{[\s\S]*\}\s*\z"
# One JSON string, and the colon behind it when it is a key. All strings are
# matched, keys too: skipping keys would pair up the wrong quotes.
JSON_STRING = r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?'

# Validity of JSON: a valid string, a number or literal, what remains when both are tokens, and an innermost
# object or list of tokens. A loop over members never has to give one back.
VALID_JSON_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
JSON_SCALAR = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null"
STRING_TOKEN, VALUE_TOKEN = f"{MARK}s", f"{MARK}v"
ONLY_TOKENS = rf"\A[{{}}\[\],:{MARK}sv]*+\z"
_ANY, _MEMBER = f"{MARK}[sv]", f"{STRING_TOKEN}:{MARK}[sv]"
INNERMOST = rf"\{{(?:{_MEMBER}(?:,{_MEMBER})*+)?+\}}|\[(?:{_ANY}(?:,{_ANY})*+)?+\]"


_CLASS = re.compile(r"(?<!\\)\[((?:[^\]\\]|\\.)*)\]")
_RANGE = re.compile(r"([A-Za-z0-9])-([A-Za-z0-9])")


def spelled_out(pattern: str) -> str:
    """The pattern with each range like `a-f` in a class written as `abcdef`.

    Java looks a single character up in one table, but tries ranges one by one:
    for classes of several ranges, as here, this nearly halves the time.
    """
    def spell(bounds: re.Match) -> str:
        first, last = (ord(c) for c in bounds.groups())
        return "".join(map(chr, range(first, last + 1)))

    return _CLASS.sub(lambda c: f"[{_RANGE.sub(spell, c[1])}]", pattern)


def any_word(*words: str) -> str:
    """A quick test for any of `words`, ignoring ASCII case.

    Spelled as letter classes behind a look at the first letter, which Java
    scans about twice as fast as an ignore-case alternation.
    """
    def both_cases(char: str) -> str:
        return f"[{char.lower()}{char.upper()}]" if char.isalpha() else f"[{char}]"

    firsts = "".join(sorted({c for w in words for c in (w[0].lower(), w[0].upper())}))
    spelled = "|".join("".join(map(both_cases, w)) for w in words)
    return f"(?=[{firsts}])(?:{spelled})"
