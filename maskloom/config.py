"""Settings of a masking job, and the fixed values that belong to them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from maskloom.functions.matching import RESERVED

# --- Fixed values -----------------------------------------------------------
# Sensitive-value types a job can target, and the code each writes in a token.
TYPE_CODES = {
    "IPv4Address": "IP4",
    "IPv6Address": "IP6",
    "Email": "EML",
    "CreditCard": "CC",
    "SocialSecurityNumber": "SSN",
    "PhoneNumber": "PHN",
    "IBAN": "IBAN",
    "Hostname": "HOST",
    "FQDN": "FQDN",
    "DomainUser": "USR",
    "Username": "USR",
    "CertificateThumbprint": "THUMB",
    "BearerToken": "TKN",
    "ConnectionStringPassword": "SEC",
}
UNKNOWN_TYPE_CODE = "ID"

# Words that keep an account, host or domain name from being masked.
ALLOWED_WORDS = (
    "manager", "files", "system", "authority", "network", "service",
    "component", "configuration", "microsoft", "windows", "program", "local",
    "adminui", "intune", "executive", "monitor",
)

# File extensions of the directory job, and of a folder tree.
LOG_EXTENSIONS = (".log", ".txt")
TREE_EXTENSIONS = (".log", ".txt", ".csv", ".json", ".xml", ".out", ".trace")

# Names ending like this were written by an earlier run and are not read again.
MASKED_SUFFIX = "_sanitized"
MASKED_LOG_ENDING = "_sanitized.log"

# How deep a JSON object may be nested to be masked as one.
JSON_DEPTH = 64

DEFAULT_PLACEHOLDER = "[REDACTED]"
JOB_PLACEHOLDER = "***"
DEFAULT_TARGETS = ("IPv4Address", "Email")
JOB_TARGETS = ("IPv4Address", "Email", "CreditCard")
BATCH_TARGETS = ("IPv4Address", "Email", "CreditCard", "Username")
# ----------------------------------------------------------------------------

# Salts made by `generate_salt` have this form, so that the session setting
# spark.sql.redaction.string.regex can blot them out of plans and the UI.
SALT_REDACTION_REGEX = "mlsalt-[0-9a-f]{32}"


def generate_salt() -> str:
    """A random salt. Keep it: equal values get equal tokens only under one salt."""
    return f"mlsalt-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class MaskConfig:
    """What to mask and how.

    `salt` has no default on purpose. A salt drawn at random per run would give
    a restarted, retried or streaming job other tokens than before; pass "" for
    unsalted tokens.

    `scrub_terms` are removed wherever they occur, ignoring case; `site_words`
    are removed as whole words.

    Objects nested deeper than `json_depth` are masked as text.

    `json_ascii` writes JSON strings with every character outside plain ASCII,
    and each of <>&'+`", as a \\u escape; with False they are written as they
    are. Both spell the same JSON value.
    """

    salt: str = field(repr=False)
    targets: tuple[str, ...] = ()
    hashing: bool = True
    placeholder: str = DEFAULT_PLACEHOLDER
    extensions: tuple[str, ...] = LOG_EXTENSIONS
    detect_json: bool = True
    json_depth: int = JSON_DEPTH
    json_ascii: bool = True
    overwrite: bool = False
    scrub_terms: tuple[str, ...] = ()
    site_words: tuple[str, ...] = ()
    protect_tokens: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.salt, str):
            raise TypeError("salt must be a string")
        for name in ("targets", "extensions", "scrub_terms", "site_words"):
            value = getattr(self, name)
            if isinstance(value, str):
                raise TypeError(f"{name} must be a list of strings")
            object.__setattr__(self, name, tuple(value))
        unknown = [t for t in self.targets if t not in TYPE_CODES]
        if unknown:
            raise ValueError(f"unknown target types: {', '.join(unknown)}")
        if any(not term for term in self.scrub_terms + self.site_words):
            raise ValueError("scrub_terms and site_words must not be empty strings")
        if any(char in self.placeholder for char in RESERVED):
            raise ValueError("the placeholder holds a reserved noncharacter")

    @classmethod
    def default(cls, salt: str, **settings) -> MaskConfig:
        return cls(salt, **{"targets": DEFAULT_TARGETS, **settings})

    @classmethod
    def for_job(cls, salt: str, **settings) -> MaskConfig:
        return cls(salt, **{"targets": JOB_TARGETS, "placeholder": JOB_PLACEHOLDER, **settings})

    @classmethod
    def for_batch(cls, salt: str, **settings) -> MaskConfig:
        return cls(salt, **{"targets": BATCH_TARGETS, "placeholder": JOB_PLACEHOLDER, **settings})

    @classmethod
    def all_types(cls, salt: str, **settings) -> MaskConfig:
        return cls(salt, **{"targets": tuple(TYPE_CODES), **settings})
