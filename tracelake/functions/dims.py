"""Small fixed dimensions: prices, detectors, suppressors, playbooks."""

from __future__ import annotations

from dataclasses import dataclass

# USD per million tokens as (input, output, cache write, cache read), by model id.
PRICES: dict[str, tuple[float, float, float, float]] = {
    "claude-opus-4-8": (5.00, 25.00, 6.25, 0.50),
    "claude-opus-4-7": (5.00, 25.00, 6.25, 0.50),
    "claude-opus-4-6": (5.00, 25.00, 6.25, 0.50),
    "claude-opus-4-5": (5.00, 25.00, 6.25, 0.50),
    "claude-opus-4-1": (15.00, 75.00, 18.75, 1.50),
    "claude-opus-4": (15.00, 75.00, 18.75, 1.50),
    "claude-sonnet-4-6": (3.00, 15.00, 3.75, 0.30),
    "claude-sonnet-4-5": (3.00, 15.00, 3.75, 0.30),
    "claude-sonnet-4": (3.00, 15.00, 3.75, 0.30),
    "claude-haiku-4-5": (1.00, 5.00, 1.25, 0.10),
    "claude-haiku-4": (1.00, 5.00, 1.25, 0.10),
    "claude-3-5-haiku": (0.80, 4.00, 1.00, 0.08),
    "gpt-5-codex": (2.00, 10.00, 2.00, 0.20),
    "gpt-5": (2.50, 10.00, 2.50, 0.25),
    "gpt-5.5": (2.50, 10.00, 2.50, 0.25),
    "gpt-5-mini": (0.25, 2.00, 0.25, 0.025),
    "codex-auto-review": (2.00, 10.00, 2.00, 0.20),
    "gpt-4o": (2.50, 10.00, 2.50, 1.25),
    "gpt-4o-mini": (0.15, 0.60, 0.15, 0.075),
    "o1": (15.00, 60.00, 15.00, 7.50),
    "o1-mini": (1.10, 4.40, 1.10, 0.55),
    "o3": (2.00, 8.00, 2.00, 0.50),
    "o3-mini": (1.10, 4.40, 1.10, 0.55),
}
RATES = ("input", "output", "cache_write", "cache_read")


def milli_prices() -> list[tuple]:
    """(model, rates...) in thousandths of a dollar, all whole numbers, so sums are exact."""
    return [(model, *[round(1000 * x) for x in rates]) for model, rates in PRICES.items()]


def is_verified(model: str) -> bool:
    return model.startswith("claude-")


@dataclass(frozen=True)
class Detector:
    category: str
    pattern: str
    confidence: int
    needle: str  # a line without it (in lower case if the expression ignores case) has no match
    group: int = 0  # the group that holds the secret
    before: str = ""  # characters that may stand before the needle in a match


# Categories, expressions and confidences of the detectors, in order.
DETECTORS = (
    Detector("anthropic_key", r"sk-ant-[A-Za-z0-9_\-]{20,}", 10, "sk-ant-"),
    Detector("openai_key", r"sk-(?:proj-)?[A-Za-z0-9_\-]{20,}", 10, "sk-"),
    Detector("github_pat", r"ghp_[A-Za-z0-9]{30,}", 10, "ghp_"),
    Detector("github_fine_grained_pat", r"github_pat_[A-Za-z0-9_]{40,}", 10, "github_pat_"),
    Detector("github_app_token", r"ghs_[A-Za-z0-9]{30,}", 10, "ghs_"),
    Detector("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", 9, "AKIA"),
    Detector("slack_token", r"xox[baprs]-[A-Za-z0-9-]{10,}", 9, "xox"),
    Detector("jwt", r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b", 8, "eyJ"),
    Detector("bearer_token", r"(?i)bearer\s+([A-Za-z0-9_\-\.]{20,})", 7, "bearer", 1),
    Detector("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 7, "@", before="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"),
)
# Anchors, entropy rule, suppressed domains and names, line limit, recommendation words.
ANCHORS = ("sk-", "@", "ghp_", "AKIA", "eyJ", "ghs_", "github_pat_", "xox", "Bearer ", "bearer ")
ENTROPY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
ENTROPY_LENGTHS = (40, 200)
ENTROPY_SKIP = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
ENTROPY_BANDS = ((5.5, 6), (5.0, 5), (4.5, 4))
ENTROPY_MIN_UNIQUE = 23
RESERVED_DOMAINS = ("example.com", "example.org", "example.net")
RESERVED_SUFFIXES = (".test", ".example", ".invalid", ".localhost")
NOREPLY = ("noreply", "no-reply", "do-not-reply", "donotreply")
PLACEHOLDER_DOMAINS = ("domain.com", "email.com", "yourdomain.com", "yoursite.com", "mysite.com")
LINE_LIMIT = 16384
RECOMMENDED_WORDS = ("recommended", "推荐", "推薦", "推奨", "권장", "recomendado", "recommandé", "empfohlen")

# Severity by category; the advice is our own.
PLAYBOOKS = {
    "openai_key": ("critical", "Revoke the key in the vendor console and issue a new one."),
    "anthropic_key": ("critical", "Revoke the key in the vendor console and issue a new one."),
    "github_pat": ("critical", "Delete the token in the account settings and check its audit log."),
    "github_oauth": ("high", "Revoke the grant of the application and sign in anew."),
    "aws_access_key": ("critical", "Deactivate the key, look through its use, then delete it."),
    "aws_secret": ("critical", "Deactivate the key, look through its use, then delete it."),
    "slack_token": ("high", "Rotate the token of the application."),
    "jwt": ("critical", "Rotate the signing key or shorten the validity of tokens."),
    "gcp_service_account": ("critical", "Delete the service account key and make a new one."),
    "email": ("low", "Consider whether this address should be in a transcript."),
    "high_entropy": ("medium", "Find out what this value opens; rotate it if it is a credential."),
}
PLAYBOOK_FALLBACK = ("high", "Find the owner of this credential and rotate it.")
