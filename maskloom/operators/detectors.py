"""The detectors, in the order in which they have to run.

A detector finds matches of one pattern and says, for each, which part is the
sensitive value and which text stays around its token. Order is meaning: a later
detector sees the tokens of an earlier one (`Server=x` is tokenized as a key's
value, and its token then again as part of a connection string), and a phone
number takes some addresses before the IPv4 detector sees them.

Each detector names what it `needs`: characters and small patterns that occur in
every text it can match. Most texts lack one of them and skip the costly pattern.
A `trigger` is a set of characters of which such a text has at least one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from maskloom.config import ALLOWED_WORDS, MaskConfig
from maskloom.functions import patterns as rx
from maskloom.functions.matching import any_literal, literal_replacement, split_matches, split_shortened, unshield
from maskloom.functions.patterns import any_word, spelled_out
from maskloom.functions.tokens import key_token, type_code


@dataclass(frozen=True)
class Hit:
    """One match taken apart: head + value + tail, as Columns.

    `keep` says that the match is left alone. `bare` writes the token without
    its brackets. `maskable` lets the placeholder take the token's place;
    `masks_head` has it replace the head, too. `any_text` marks values that may
    hold any character, and so the stand-ins of `shield`.
    """

    code: Column | str
    value: Column
    head: Column | None = None
    tail: Column | None = None
    keep: Column | None = None
    bare: Column | None = None
    maskable: bool = False
    masks_head: bool = False
    any_text: bool = False

    def plain_value(self) -> Column:
        return unshield(self.value) if self.any_text else self.value

    def token(self, cfg: MaskConfig) -> Column:
        if self.maskable and not cfg.hashing:
            return F.lit(cfg.placeholder)
        return key_token(self.code, self.plain_value(), cfg)

    def replacement(self, token: Column, cfg: MaskConfig) -> Column:
        """What to write for the match, given its token."""
        if self.bare is not None:
            bare = F.substring(token, F.lit(2), F.length(token) - 2)
            token = F.when(self.bare, bare).otherwise(token)
        if self.masks_head and not cfg.hashing:
            return token
        around = [part for part in (self.head, token, self.tail) if part is not None]
        return F.concat(*around) if len(around) > 1 else token


@dataclass(frozen=True)
class Detector:
    name: str
    type_name: str
    pattern: str
    needs: tuple[str, ...]
    take_apart: Callable[[Column], Hit]
    trigger: str | None = None
    end: str | None = None

    def pieces(self, text: Column) -> Column:
        """A shielded text as gap, match, gap, ... With `end`, a match of the pattern ends at the last `end` in it."""
        pattern = spelled_out(self.pattern)
        return split_matches(text, pattern) if self.end is None else split_shortened(text, pattern, spelled_out(self.end))

    def rewrite(self, match: Column, cfg: MaskConfig) -> Column:
        hit = self.take_apart(match)
        new = hit.replacement(hit.token(cfg), cfg)
        return new if hit.keep is None else F.when(hit.keep, match).otherwise(new)

    def hint(self, text: Column) -> Column:
        return looks_like(text, self.needs)


@dataclass(frozen=True)
class Scrubber:
    """A detector that writes a constant and keeps no trace of the value."""

    name: str
    pattern: str
    constant: str
    needs: tuple[str, ...] = ()

    def replace(self, text: Column) -> Column:
        new = F.regexp_replace(text, spelled_out(self.pattern), literal_replacement(self.constant))
        return F.when(looks_like(text, self.needs), new).otherwise(text) if self.needs else new


def _group(match: Column, pattern: str, index: int) -> Column:
    # None of the patterns with groups looks beyond its match, so the match
    # alone splits into groups the same way.
    return F.regexp_extract(match, pattern, index)


def _is_one_of(key: Column, *names: str) -> Column:
    return F.lower(key).isin(*names)


def _whole(code: str, maskable: bool = False) -> Callable[[Column], Hit]:
    return lambda match: Hit(code, match, maskable=maskable)


def _api_key(match: Column) -> Hit:
    return Hit("APIKEY", _group(match, rx.API_KEY, 2), head=_group(match, rx.API_KEY, 1))


def _bearer(match: Column) -> Hit:
    return Hit("TOKEN", match, head=F.lit("Bearer "), maskable=True, masks_head=True)


def _ipv6(match: Column) -> Hit:
    too_short = F.length(match) <= 5
    return Hit("IP6", match, keep=match.rlike(rx.CLOCK_TIME) | too_short)


def _site_path(match: Column) -> Hit:
    return Hit("SITE", _group(match, rx.SITE_PATH, 2), head=_group(match, rx.SITE_PATH, 1))


def _key_value(match: Column) -> Hit:
    key, separator, opening, value, closing = (
        _group(match, rx.KEY_VALUE, i) for i in range(1, 6))
    code = (F.when(_is_one_of(key, "sitecode", "site"), "SITE")
            .when(_is_one_of(key, "databasename", "database", "catalog"), "DB")
            .otherwise("SRV"))
    return Hit(code, value, head=F.concat(key, separator, opening), tail=closing,
               bare=(opening != "") | (closing != ""), any_text=True)


def _url(match: Column) -> Hit:
    scheme, host, port, path = (_group(match, rx.URL, i) for i in range(1, 5))
    return Hit("FQDN", host, head=F.concat(scheme, F.lit("://")), tail=F.concat(port, path))


def _connection_pair(match: Column) -> Hit:
    key, value = (_group(match, rx.CONNECTION_PAIR, i) for i in (1, 2))
    code = (F.when(_is_one_of(key, "data source", "server"), "SRV")
            .when(_is_one_of(key, "initial catalog", "database"), "DB")
            .otherwise("SEC"))
    return Hit(code, value, head=F.concat(key, F.lit("=")), any_text=True)


def _ldap_name(match: Column) -> Hit:
    part, value = (_group(match, rx.LDAP_NAME, i) for i in (1, 2))
    return Hit("DN", value, head=F.concat(part, F.lit("=")), any_text=True)


def _secret(match: Column) -> Hit:
    return Hit(type_code("ConnectionStringPassword"), match, maskable=True, any_text=True)


def has_allowed_word(match: Column) -> Column:
    """Whether a part of the match, cut at spaces, slashes and `_`, is a common word.

    Other signs inside a part do not count: `net-work` is `network`.
    """
    parts = F.regexp_replace(match, r"(?U)[^\w \t\r\n\\/]", "")
    edge = r"[ \t\r\n\\/_]"
    return parts.rlike(f"(?i)(?:^|{edge})(?:{'|'.join(ALLOWED_WORDS)})(?:$|{edge})")


def _typed(type_name: str) -> Callable[[Column], Hit]:
    return lambda match: Hit(type_code(type_name), match, maskable=True)


def _named(type_name: str) -> Callable[[Column], Hit]:
    return lambda match: Hit(type_code(type_name), match, maskable=True,
                             keep=F.contains(match, F.lit("[")) | has_allowed_word(match))


def looks_like(text: Column, needs: tuple[str, ...]) -> Column:
    """Whether the text has everything a detector needs, cheapest test first."""
    tests = [F.contains(text, F.lit(need)) if len(need) == 1 else text.rlike(spelled_out(need))
             for need in needs]
    return reduce(lambda one, other: one & other, tests)


def any_needed(steps: Sequence[Detector | Scrubber]) -> str | None:
    """A pattern found in every text that any of the steps can change.

    None if a step says nothing about its needs. Of each step its trigger, a
    set of characters, or else its first need counts; the characters of all
    steps become one class, which is the quickest thing to scan for.
    """
    if any(not step.needs for step in steps):
        return None
    characters, patterns = [], []
    for step in steps:
        trigger = getattr(step, "trigger", None)
        if trigger is not None:
            characters.append(trigger)
        elif len(step.needs[0]) == 1:
            characters.append("\\" + step.needs[0])
        else:
            patterns.append(f"(?:{step.needs[0]})")
    one_class = [f"[{''.join(dict.fromkeys(characters))}]"] if characters else []
    return spelled_out("|".join(one_class + list(dict.fromkeys(patterns))))


_DIGIT = r"\p{Nd}"
_BEARER = any_word("bearer") + r"(?U:\s)"

API_KEYS = Detector("api_keys", "ApiKey", rx.API_KEY, ("-" + any_word("key"),), _api_key)
BEARER = Detector("bearer", "BearerToken", rx.BEARER, (_BEARER,), _bearer)
IPV6 = Detector("ipv6", "IPv6Address", rx.IPV6, (":", ":[0-9A-Fa-f]{0,4}:"), _ipv6)
SITE_PATHS = Detector("site_paths", "SiteCode", rx.SITE_PATH,
                      ("_", any_word("sms_", "site_")), _site_path)
LDAP_DOMAINS = Scrubber("ldap_domains", rx.LDAP_DOMAIN, rx.SCRUBBED_DOMAIN, ("=",))
KEY_VALUES = Detector("key_values", "KeyValue", rx.KEY_VALUE,
                      ("[=:]", any_word("site", "database", "catalog", "server", "source")), _key_value,
                      trigger="=:")
URL_HOSTS = Detector("url_hosts", "UrlHost", rx.URL, (":", "://"), _url)
CONNECTION_PAIRS = Detector(
    "connection_pairs", "ConnectionPair", rx.CONNECTION_PAIR,
    ("=", any_word("data source", "server", "initial catalog", "database", "user id", "password")),
    _connection_pair)
EMAILS = Detector("emails", "Email", rx.EMAIL, ("@",), _whole("EMAIL"))
TR_MOBILES = Detector("tr_mobiles", "PhoneNumber", rx.TR_MOBILE,
                      (r"5(?U:\d{2}[\s\.\-]?\d{3}[\s\.\-]?\d{2})",), _whole("PHN"), _DIGIT)
PHONES = Detector("phones", "PhoneNumber", rx.PHONE,
                  (r"(?U:\d{3}\)?[\s\.\-]\d{3}[\s\.\-]\d{2})",), _whole("PHN"), _DIGIT)
CARDS = Detector("cards", "CreditCard", rx.CARD,
                 (r"(?U:\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4})",), _whole("CC"), _DIGIT)
LDAP_NAMES = Detector("ldap_names", "LdapName", rx.LDAP_NAME,
                      ("=", any_word("cn=", "ou=", "dc=")), _ldap_name)
IPV4 = Detector("ipv4", "IPv4Address", rx.IPV4,
                (r"[0-9]\.[0-9]{1,3}\.[0-9]",), _typed("IPv4Address"), _DIGIT)
SSNS = Detector("ssn", "SocialSecurityNumber", rx.SSN,
                (r"(?U:\d{3}-\d{2}-\d{4})",), _typed("SocialSecurityNumber"), _DIGIT)
IBANS = Detector("iban", "IBAN", rx.IBAN, (r"[A-Z]{2}(?U:\d{2})[A-Z0-9]{4}(?U:\d{7})",), _typed("IBAN"), _DIGIT)
THUMBPRINTS = Detector("thumbprints", "CertificateThumbprint", rx.THUMBPRINT,
                       ("[0-9a-fA-F]{40}",), _typed("CertificateThumbprint"))
BEARER_AGAIN = Detector("bearer_again", "BearerToken", rx.BEARER, (_BEARER,), _typed("BearerToken"))
CONNECTION_SECRETS = Detector(
    "connection_secrets", "ConnectionStringPassword", rx.CONNECTION_SECRET,
    ("=", any_word("password=", "pwd=", "user id=", "uid=")), _secret)
DOMAIN_USERS = Detector("domain_users", "DomainUser", rx.DOMAIN_USER, ("\\",), _named("DomainUser"))
USERNAMES = Detector("usernames", "Username", rx.USERNAME, ("\\",), _named("Username"))
HOSTNAMES = Detector("hostnames", "Hostname", rx.HOSTNAME,
                     (any_word("sw", "srv", "server"),), _named("Hostname"))
# With `protect_tokens`, a token in brackets is not taken for a host name.
HOSTNAMES_BESIDE_TOKENS = Detector(
    "hostnames", "Hostname", r"(?!(?<=\[)[A-Z0-9]{2,6}-[0-9A-F]{6}\])" + rx.HOSTNAME,
    HOSTNAMES.needs, HOSTNAMES.take_apart)
FQDNS = Detector("fqdns", "FQDN", rx.FQDN, (r"\.[a-zA-Z]{2}",), _named("FQDN"), end=rx.FQDN_END)
IPV6_TAILS = Scrubber("ipv6_tails", rx.IPV6_TAIL, "", (r"\[IP6-",))

# Run whatever the targets are. Targeting Email, CreditCard, PhoneNumber or
# IPv6Address therefore changes nothing.
ALWAYS = (API_KEYS, BEARER, IPV6, SITE_PATHS, LDAP_DOMAINS, KEY_VALUES, URL_HOSTS,
          CONNECTION_PAIRS, EMAILS, TR_MOBILES, PHONES, CARDS, LDAP_NAMES)
# Run when their type is a target.
ON_REQUEST = (IPV4, SSNS, IBANS, THUMBPRINTS, BEARER_AGAIN, CONNECTION_SECRETS,
              DOMAIN_USERS, USERNAMES, HOSTNAMES, FQDNS)


def scrub_terms(terms: tuple[str, ...]) -> Scrubber:
    pattern = "(?iu)" + any_literal(terms)
    return Scrubber("scrub_terms", pattern, rx.SCRUBBED_TERM, (pattern,))


def scrub_site_words(words: tuple[str, ...]) -> Scrubber:
    pattern = "(?iu)" + any_literal(words)
    return Scrubber("scrub_site_words", rf"(?iuU)\b{any_literal(words)}\b", rx.SCRUBBED_SITE, (pattern,))


def active_detectors(cfg: MaskConfig) -> list[Detector | Scrubber]:
    """The detectors of a job in running order; nothing is kept for inactive ones."""
    chain: list[Detector | Scrubber] = []
    if cfg.scrub_terms:
        chain.append(scrub_terms(cfg.scrub_terms))
    chain.extend(ALWAYS)
    if cfg.site_words:
        chain.append(scrub_site_words(cfg.site_words))
    for detector in ON_REQUEST:
        if detector.type_name in cfg.targets:
            chain.append(HOSTNAMES_BESIDE_TOKENS if cfg.protect_tokens and detector is HOSTNAMES
                         else detector)
    chain.append(IPV6_TAILS)
    return chain
