"""Settings of the extraction operators, as one frozen value that UDFs capture and expressions inline."""

from __future__ import annotations

from dataclasses import dataclass, field

# Limits and word lists of the operators' contract.
HEADING_KEYWORDS = (
    "overview introduction summary conclusion prerequisites requirements installation configuration usage features limitations troubleshooting faq "
    "resources references changelog license acknowledgments appendix"
).split()
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "169.254.169.254", "metadata.google.internal", "metadata.azure.com", "100.100.100.200", "instance-data")
BLOCKED_SUFFIXES = (".local", ".internal")


@dataclass(frozen=True)
class NoiseConfig:
    nav_footer: bool = True
    cookie_banners: bool = True
    newsletters: bool = True
    social_share: bool = True
    aggressive: bool = False
    extra_tokens: tuple[str, ...] = ()
    extra_selectors: tuple[str, ...] = ()
    hidden: int = 50
    structural: int = 50
    promo: int = 35
    sticky_fixed: int = 30
    threshold: int = 50


@dataclass(frozen=True)
class CleanupConfig:
    promote_orphan_headings: bool = True
    remove_skip_links: bool = True
    remove_toc: bool = True
    remove_doc_comments: bool = True
    heading_keywords: tuple[str, ...] = tuple(HEADING_KEYWORDS)


@dataclass(frozen=True)
class ExtractConfig:
    max_bytes: int = 10 * 1024 * 1024
    max_url_length: int = 2048
    inline_limit: int = 0
    max_redirects: int = 5
    cache_ttl_seconds: int = 86_400
    cache_keys: int = 100
    cache_bytes: int = 50 * 1024 * 1024
    include_metadata: bool = True
    skip_noise: bool = False
    noise: NoiseConfig = field(default_factory=NoiseConfig)
    cleanup: CleanupConfig = field(default_factory=CleanupConfig)


DEFAULT = ExtractConfig()
MARKER = "...[truncated]"
