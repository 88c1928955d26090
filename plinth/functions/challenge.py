"""Recognise pages that refuse automated access: header marks first, then body patterns by priority, then status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header names and their confidence, in order: fixed values.
HEADERS = (("cloudflare", "cf-mitigated", 0.98), ("datadome", "x-datadome", 0.95), ("perimeterx", "x-px", 0.92), ("imperva", "x-iinfo", 0.88), ("akamai", "x-akamai-bot", 0.88))
#: Body patterns and their confidence, in order: fixed values.
BODIES = (
    ("cloudflare", r"cf-chl|cf_chl_opt|/cdn-cgi/challenge-platform|just a moment", 0.97),
    ("recaptcha", r"g-recaptcha|recaptcha/api\.js|grecaptcha", 0.95),
    ("hcaptcha", r"h-captcha|hcaptcha\.com", 0.95),
    ("datadome", r"datadome|geo\.captcha-delivery\.com", 0.95),
    ("perimeterx", r"px-captcha|_pxcaptcha|perimeterx", 0.94),
    ("imperva", r"incapsula|_incap_ses|imperva", 0.90),
    ("akamai", r"ak_bmsc|akamai bot manager|reference\s*#[0-9]{2}\.\w+", 0.85),
    ("generic_captcha", r"captcha|are you (a )?(human|robot)|verify (that )?you are human", 0.80),
    ("generic_block", r"unusual traffic|automated (queries|requests)|access denied|bot detected|request blocked", 0.75),
)
#: Statuses that refuse by themselves: fixed values.
HARD_STATUS = (401, 403, 407, 451)


def detect(status: Column, headers: Column | None, body: Column, halt_on_429: bool = False, snippet: int | None = None) -> Column:
    """A struct (vendor, evidence, confidence), or null for an ordinary response. headers: map of lower-case names.

    The whole body is searched, or its first snippet characters where that is given.
    """
    body = body if snippet is None else F.substring(body, 1, snippet)
    low, out = F.lower(F.coalesce(body, F.lit(""))), None

    def add(test: Column, vendor: str, evidence: Column, confidence: float) -> None:
        nonlocal out
        found = F.struct(F.lit(vendor).alias("vendor"), evidence.alias("evidence"), F.lit(confidence).alias("confidence"))
        out = F.when(test, found) if out is None else out.when(test, found)

    for vendor, name, confidence in HEADERS if headers is not None else ():
        add(F.coalesce(F.map_contains_key(headers, name), F.lit(False)), vendor, F.concat(F.lit(f"header:{name}="), F.try_element_at(headers, F.lit(name))), confidence)
    for vendor, pattern, confidence in BODIES:
        add(F.regexp_like(low, F.lit(pattern)), vendor, F.concat(F.lit("body:"), F.regexp_extract(low, f"({pattern})", 1)), confidence)
    add(status.isin(*HARD_STATUS), "http_block", F.concat(F.lit("status:"), status.cast("string")), 0.70)
    if halt_on_429:
        add(status == 429, "http_throttle", F.lit("status:429"), 0.60)
    return out
