"""The token rule, spelled a second time in plain Python."""

import hashlib


def token(code, value, salt=""):
    return f"[{code}-{hashlib.sha256((value + salt).encode()).hexdigest()[:6].upper()}]"
