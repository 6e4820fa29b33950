"""The detectors once more, as SQL for DuckDB: an independent check of the results.

DuckDB's regex engine has no lookaround. Where a detector needs it, the SQL puts
a stop mark behind each character that may stand before a match. A match then
begins at a stop mark and takes the character after it along, and neighbouring
matches do not compete for the character between them.
"""

from __future__ import annotations

from dataclasses import dataclass

FENCE, GROUP, STOP = "\x01", "\x02", "\x03"

# --- Fixed values: what results must agree with ---------------------------------
TYPE_CODES = {
    "IPv4Address": "IP4", "IPv6Address": "IP6", "Email": "EML", "CreditCard": "CC",
    "SocialSecurityNumber": "SSN", "PhoneNumber": "PHN", "IBAN": "IBAN", "Hostname": "HOST",
    "FQDN": "FQDN", "DomainUser": "USR", "Username": "USR", "CertificateThumbprint": "THUMB",
    "BearerToken": "TKN", "ConnectionStringPassword": "SEC",
}
ALLOWED = ("manager", "files", "system", "authority", "network", "service", "component",
           "configuration", "microsoft", "windows", "program", "local", "adminui", "intune",
           "executive", "monitor")
EXCLUDED_ENDINGS = ("zip", "exe", "dll", "log", "txt", "png", "core")
# ----------------------------------------------------------------------------------


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def tok(code: str, value: str, brackets: bool = True) -> str:
    """SQL for the token of an SQL value; `code` is SQL, too."""
    bare = f"{code} || '-' || upper(substr(sha256({value}), 1, 6))"
    return f"('[' || {bare} || ']')" if brackets else f"({bare})"


def other_words(words: tuple[str, ...], depth: int = 0) -> str:
    """A regex for words of two letters or more that are none of `words`."""
    firsts = sorted({w[0] for w in words if w})
    rest = "[a-z]+" if depth == 0 else "[a-z]*"
    choices = [f"[{''.join(c for c in 'abcdefghijklmnopqrstuvwxyz' if c not in firsts)}]{rest}"]
    choices += [c + other_words(tuple(w[1:] for w in words if w[:1] == c), depth + 1) for c in firsts]
    if depth >= 2 and "" not in words:
        choices.append("")
    return "(?:" + "|".join(choices) + ")"


@dataclass(frozen=True)
class Stage:
    """One detector. `p` stands for the match, or `g1`, `g2`, ... for its groups."""

    type_name: str
    regex: str
    marked: str                 # what the match becomes, with fences around it
    value: str
    code: str
    output: str | None = None   # default: the token
    keep: str | None = None     # condition under which the match stays
    stops: str | None = None    # characters that get a stop mark behind them
    whole_letters: bool = False  # have letters beyond ASCII count as letters
    token: str | None = None

    def fenced(self, t: str) -> str:
        if self.stops:
            t = f"regexp_replace({t}, {text(f'([{self.stops}])')}, '\\1{STOP}', 'g')"
        if self.whole_letters:
            t = f"regexp_replace({t}, '([^\\x00-\\x7F])', '_{STOP}\\1{STOP}_', 'g')"
            t = f"regexp_replace({t}, '_{STOP}([^\\pL\\p{{Mn}}\\p{{Nd}}]){STOP}_', '\\1', 'g')"
        return f"string_split(regexp_replace({t}, {text(self.regex)}, {text(self.marked)}, 'g'), '{FENCE}')"

    def _clean(self, sql: str) -> str:
        if self.stops:
            sql = f"replace({sql}, '{STOP}', '')"
        if self.whole_letters:
            sql = f"replace(replace({sql}, '_{STOP}', ''), '{STOP}_', '')"
        return sql

    def fill(self, sql: str, piece: str) -> str:
        for n in range(5, 0, -1):
            sql = sql.replace(f"g{n}", f"string_split({piece}, '{GROUP}')[{n}]")
        return sql.replace("$p", self._clean(piece))

    def token_of(self, piece: str) -> str:
        return self.fill(self.token or tok(self.code, self.value), piece)

    def rebuilt(self, pieces: str) -> str:
        new = self.fill(self.output or self.token or tok(self.code, self.value), "x")
        if self.keep:
            new = f"CASE WHEN {self.fill(self.keep, 'x')} THEN {self._clean('x')} ELSE {new} END"
        parts = (f"list_transform({pieces}, lambda x, i: "
                 f"CASE WHEN i % 2 = 0 THEN {new} ELSE {self._clean('x')} END)")
        return f"array_to_string({parts}, '')"


def _whole(type_name: str, code: str, regex: str, **more) -> Stage:
    return Stage(type_name, f"({regex})", f"{FENCE}\\1{FENCE}", "$p", text(code), **more)


def _between(type_name: str, code: str, before: str, body: str, after: str, stops: str, **more) -> Stage:
    return Stage(type_name, f"({before})({body})({after})", f"\\1{FENCE}\\2{FENCE}\\3", "$p",
                 text(code), stops=stops, **more)


def _groups(n: int) -> str:
    return FENCE + GROUP.join(f"\\{i}" for i in range(1, n + 1)) + FENCE


_SP = r"[\s\x0b\x85\pZ]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_ALLOW = ("list_has_any(list_transform(string_split_regex(lower($p), '[ \\t\\r\\n\\\\/_]'), "
          "lambda w: regexp_replace(w, '[^\\w]', '', 'g')), ["
          + ", ".join(map(text, ALLOWED)) + "])")
_KV_CODE = ("CASE WHEN lower(g1) IN ('sitecode', 'site') THEN 'SITE' "
            "WHEN lower(g1) IN ('databasename', 'database', 'catalog') THEN 'DB' ELSE 'SRV' END")
_PAIR_CODE = ("CASE WHEN lower(g1) IN ('data source', 'server') THEN 'SRV' "
              "WHEN lower(g1) IN ('initial catalog', 'database') THEN 'DB' ELSE 'SEC' END")

API_KEY = Stage("ApiKey", rf"(?i)\b((?:x-)?api-key{_SP}*[:=]{_SP}*)([A-Za-z0-9]+)", _groups(2),
                "g2", "'APIKEY'", output="g1 || " + tok("'APIKEY'", "g2"))
BEARER = Stage("BearerToken", rf"(?i)(\bBearer{_SP}+[A-Za-z0-9\-\._~\+\/]+=*)", _groups(1),
               "$p", "'TOKEN'", output="'Bearer ' || " + tok("'TOKEN'", "$p"))
IPV6 = _whole("IPv6Address", "IP6",
              r"(?i:(?:[A-Fa-f0-9]{1,4}:){2,}(?:[A-Fa-f0-9]{1,4}|:)|fe80::[A-Fa-f0-9:%]+)",
              keep=r"regexp_full_match($p, '\d{2}:\d{2}:\d{2}') OR length($p) <= 5")
SITE_PATH = Stage("SiteCode", r"(?i)(SMS_|site_)([a-zA-Z0-9]{3})", _groups(2), "g2", "'SITE'",
                  output="g1 || " + tok("'SITE'", "g2"))
KEY_VALUE = Stage(
    "KeyValue",
    r"(?i)(SiteCode|Site|DatabaseName|Database|Catalog|SQLServerName|Server|Source)"
    rf"({_SP}*\]?{_SP}*[:=]{_SP}*)([""\"" r"'\[]?)([^""\"" r"'\s\x0b\x85\pZ\],;]+)([""\"" r"'\]]?)",
    _groups(5), "g4", f"({_KV_CODE})",
    output="g1 || g2 || g3 || CASE WHEN g3 <> '' OR g5 <> '' THEN "
           + tok(f"({_KV_CODE})", "g4", brackets=False) + " ELSE "
           + tok(f"({_KV_CODE})", "g4") + " END || g5")
URL = Stage("UrlHost", r"(?i)\b(https?|ftp)://([a-zA-Z0-9\.-]+)(:[0-9]+)?(/[^ \t\r\n]*)?", _groups(4),
            "g2", "'FQDN'", output="g1 || '://' || " + tok("'FQDN'", "g2") + " || g3 || g4")
PAIR = Stage("ConnectionPair",
             rf"(?i)(Data Source|Server|Initial Catalog|Database|User ID|Password){_SP}*={_SP}*([^;]+)",
             _groups(2), "g2", f"({_PAIR_CODE})", output="g1 || '=' || " + tok(f"({_PAIR_CODE})", "g2"))
EMAIL = _whole("Email", "EMAIL",
               r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-][A-Za-z0-9.-]*(?:\.[A-Za-z]{2,})?\b")
_SEP = rf"[\s\x0b\x85\pZ.\-]{STOP}"
TR_MOBILE = _between("PhoneNumber", "PHN", f"^|{STOP}",
                     rf"(?:\+{STOP}90|0)(?:{_SP}{STOP})*5\d{{2}}(?:{_SEP})?\d{{3}}(?:{_SEP})?\d{{2}}"
                     rf"(?:{_SEP})?\d{{2}}\b", "", "^A-Za-z0-9")
_AREA = rf"(?:\({STOP})?\d{{3}}(?:\){STOP})?"
PHONE = _between("PhoneNumber", "PHN", f"^|{STOP}",
                 rf"(?:\+{STOP}|00)?(?:\d{{1,3}}{_SEP})?(?:{_AREA}{_SEP}\d{{3}}{_SEP}\d{{4}}"
                 rf"|{_AREA}{_SEP}\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}})", "$|[^A-Za-z0-9]", "^A-Za-z0-9")
CARD = _whole("CreditCard", "CC", r"\b(?:\d{4}[- ]?){3}\d{4}\b")
LDAP = Stage("LdapName", r"(?i)\b(CN|OU|DC)=([^,]+)", _groups(2), "g2", "'DN'",
             output="g1 || '=' || " + tok("'DN'", "g2"))
IPV4 = _between("IPv4Address", "IP4", f"^|{STOP}", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"$|[^\w.]", r"^\w.")
SSN = _whole("SocialSecurityNumber", "SSN", r"\b\d{3}-\d{2}-\d{4}\b")
IBAN = _whole("IBAN", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b")
THUMB = _whole("CertificateThumbprint", "THUMB", r"\b[0-9a-fA-F]{40}\b")
BEARER_AGAIN = _whole("BearerToken", "TKN", rf"(?i:\bBearer{_SP}+[A-Za-z0-9\-\._~\+\/]+=*)")
SECRET = Stage("ConnectionStringPassword", "(?i)((?:Password|Pwd|User ID|Uid)=)([^;]*)",
               f"\\1{FENCE}\\2{FENCE}", "$p", "'SEC'")
DOMAIN_USER = _whole("DomainUser", "USR", r"\b[a-zA-Z0-9-]{2,15}\\{1,2}[a-zA-Z0-9._-]{2,30}\b", keep=_ALLOW)
USERNAME = _between("Username", "USR", f"^|{STOP}",
                    rf"[a-zA-Z0-9-]{{2,15}}\\{STOP}[a-zA-Z0-9._-]{{2,30}}",
                    "$|[\\s\"'\\\\\\]]", "\\s\"'\\\\", keep=_ALLOW)
HOST = _whole("Hostname", "HOST", r"(?i:\b[a-zA-Z0-9-]*(?:SW|SRV|SERVER)[a-zA-Z0-9-]*\b)",
              keep=_ALLOW, whole_letters=True)
FQDN = _whole("FQDN", "FQDN", r"(?i:\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+"
              + other_words(EXCLUDED_ENDINGS) + r"\b)", keep=_ALLOW)

LDAP_DOMAIN = ("(?i)DC=[a-zA-Z0-9-]+", "DC=[DOMAIN]")
IPV6_TAIL = (r"(\[IP6-[0-9A-F]{6}\])(?:%[0-9A-Za-z]+|:[0-9]+)", r"\1")

ALWAYS = (API_KEY, BEARER, IPV6, SITE_PATH, LDAP_DOMAIN, KEY_VALUE, URL, PAIR, EMAIL, TR_MOBILE,
          PHONE, CARD, LDAP)
GATED = (IPV4, SSN, IBAN, THUMB, BEARER_AGAIN, SECRET, DOMAIN_USER, USERNAME, HOST, FQDN)
DEFAULT_CHAIN = (*ALWAYS, IPV4, IPV6_TAIL)
FULL_CHAIN = (*ALWAYS, *GATED, IPV6_TAIL)


def apply_stage(stage, t: str) -> str:
    if isinstance(stage, tuple):
        return f"regexp_replace({t}, {text(stage[0])}, {text(stage[1])}, 'g')"
    return stage.rebuilt(stage.fenced(t))


class Chain:
    """A WITH clause that sends the column `t` of `base` through stages, one CTE each."""

    def __init__(self, base: str, keep: tuple[str, ...], chain: tuple, name: str = "s"):
        self.keep, self.chain, self.name = ", ".join(keep), chain, name
        self.ctes = [f"{name}0 AS MATERIALIZED ({base})"]
        before = f"{self.keep}, " if keep else ""
        self.before = before
        for n, stage in enumerate(chain, 1):
            if isinstance(stage, tuple):
                self.ctes.append(f"{name}{n} AS MATERIALIZED (SELECT {before}{apply_stage(stage, 't')} AS t "
                                 f"FROM {name}{n - 1})")
            else:
                self.ctes.append(f"{name}{n}p AS MATERIALIZED (SELECT {before}{stage.fenced('t')} AS ps "
                                 f"FROM {name}{n - 1})")
                self.ctes.append(f"{name}{n} AS MATERIALIZED (SELECT {before}{stage.rebuilt('ps')} AS t "
                                 f"FROM {name}{n}p)")
        self.last = f"{name}{len(chain)}"

    def findings(self) -> str:
        """A SELECT of what every stage found, in the order type, pos, value, token."""
        found = [found_by(stage, f"{self.name}{n}p", self.before)
                 for n, stage in enumerate(self.chain, 1) if isinstance(stage, Stage)]
        return " UNION ALL ".join(found)


def found_by(stage: Stage, table: str, before: str) -> str:
    kept = f" AND NOT ({stage.fill(stage.keep, 'x')})" if stage.keep else ""
    return (f"SELECT {before}{text(stage.type_name)} AS type, CAST(i AS INTEGER) AS pos, "
            f"{stage.fill(stage.value, 'x')} AS value, {stage.token_of('x')} AS token "
            f"FROM (SELECT {before}unnest(list_filter(ps, lambda x, i: i % 2 = 0)) AS x, "
            f"unnest(generate_series(0, len(ps) // 2 - 1)) AS i FROM {table}) WHERE true{kept}")
