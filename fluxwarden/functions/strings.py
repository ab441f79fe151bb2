"""String and DNS features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import bind

#: Shares of frequent English bigrams, usual second-level domains, and patterns of tunnelled labels.
ENGLISH_BIGRAMS = {
    "th": 0.0356, "he": 0.0307, "in": 0.0243, "er": 0.0205, "an": 0.0199,
    "on": 0.0177, "re": 0.0172, "nd": 0.0148, "en": 0.0141, "at": 0.0132,
    "es": 0.0132, "st": 0.0125, "ed": 0.0117, "or": 0.0115, "to": 0.0113,
}
BENIGN_SLDS = (
    "google.com", "googleapis.com", "gstatic.com", "github.com",
    "amazonaws.com", "cloudfront.net", "fastly.net", "akamai.net",
    "microsoft.com", "windows.com", "office.com", "azure.com",
    "apple.com", "icloud.com", "cdn-apple.com",
)
TUNNEL_PATTERNS = (
    r"^[a-f0-9]{32,}$",
    r"^[A-Za-z0-9+/]{20,}={0,2}$",
    r"^[a-z0-9]{40,}$",
    r"^\d{1,3}-\d{1,3}-\d{1,3}-\d{1,3}$",
)


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def pairs(s: Column) -> Column:
    """Neighbouring characters; texts under two characters have none."""
    return F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def entropy_of(items: Column) -> Column:
    """Shannon entropy in bits of an array's values; 0 when it is empty."""

    def of(a: Column) -> Column:
        share = F.transform(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) / F.size(a))
        return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)) + F.lit(0.0)

    return F.coalesce(bind(items, of), F.lit(0.0))


def string_entropy(s: Column) -> Column:
    return entropy_of(chars(F.coalesce(s, F.lit(""))))


def byte_entropy(data: Column) -> Column:
    """Entropy of a binary column's bytes, rounded to four places."""
    return F.round(entropy_of(F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1)), 4)


def bigram_entropy(s: Column) -> Column:
    return entropy_of(pairs(F.coalesce(s, F.lit(""))))


def bigram_deviation(s: Column) -> Column:
    """Sum over the English bigrams of |share here - expected|; 0 for texts under four characters."""

    def of(a: Column) -> Column:
        share = lambda gram: F.size(F.filter(a, lambda x: x == gram)) / F.size(a)
        terms = [F.abs(share(gram) - F.lit(p)) for gram, p in ENGLISH_BIGRAMS.items()]
        return sum(terms[1:], terms[0])

    s = F.coalesce(s, F.lit(""))
    return F.when(F.length(s) >= 4, bind(pairs(s), of)).otherwise(F.lit(0.0))


def normal_query(q: Column) -> Column:
    return F.regexp_replace(F.lower(q), r"\.+$", "")


def labels(q: Column) -> Column:
    return F.split(q, r"\.")


def subdomain(q: Column) -> Column:
    """All labels but the last two, or the first of one or two."""
    parts = labels(q)
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), ".")).otherwise(F.get(parts, F.lit(0)))


def second_level(q: Column) -> Column:
    parts = labels(q)
    return F.when(F.size(parts) >= 2, F.concat_ws(".", F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1))).otherwise(q)


def max_label_length(q: Column) -> Column:
    return F.array_max(F.transform(labels(q), F.length))


def unique_chars(s: Column) -> Column:
    return F.size(F.array_distinct(chars(s)))


def share_of(s: Column, char_class: str) -> Column:
    """Share of the characters in a class such as ``aeiou`` or ``0-9``; 0 for the empty text."""
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, f"[^{char_class}]", "")) / F.length(s)).otherwise(F.lit(0.0))


def max_run(s: Column, char_class: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"[{char_class}]+"), 0), F.length)), F.lit(0))


def longest_class_run(s: Column) -> Column:
    """Longest run of letters, of digits or of anything else (lower-case text)."""
    return F.greatest(max_run(s, "a-z"), max_run(s, "0-9"), max_run(s, "^a-z0-9"))


def longest_class_run_base0(s: Column) -> Column:
    """The same, but 0 where no run is longer than one."""
    run = longest_class_run(s)
    return F.when(run > 1, run).otherwise(F.lit(0))


def matches_tunnel(label: Column) -> Column:
    out = F.lit(False)
    for p in TUNNEL_PATTERNS:
        out = out | label.rlike(p)
    return out


def dns_features(q: Column) -> dict[str, Column]:
    """Features of a query name; lengths and ratios refer to the normalised name."""
    n = normal_query(F.coalesce(q, F.lit("")))
    sub = subdomain(n)
    return {
        "dns_query_len": F.length(n), "dns_label_count": F.size(labels(n)), "dns_max_label_len": max_label_length(n),
        "dns_unique_chars": unique_chars(n), "dns_shannon_entropy": string_entropy(sub), "dns_bigram_entropy": bigram_entropy(sub),
        "dns_vowel_ratio": share_of(sub, "aeiou"), "dns_digit_ratio": share_of(sub, "0-9"), "dns_hyphen_ratio": share_of(sub, "-"),
        "dns_is_ip_encoded": n.rlike("^[0-9a-f]{8}").cast("int"), "dns_consecutive_digits": max_run(n, "0-9"), "dns_longest_run": longest_class_run(n),
        "dns_underscores": F.length(n) - F.length(F.replace(n, F.lit("_"), F.lit(""))), "dns_matches_tunnel_pattern": matches_tunnel(sub).cast("int"),
        "dns_known_sld": second_level(n).isin(*BENIGN_SLDS).cast("int"),
    }


def query_flags(query_type: Column, answer_code: Column) -> dict[str, Column]:
    """Whether the name doesn't exist, and record types that tunnels like."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {"dns_is_nxdomain": flag(answer_code == 3), **{f"dns_qtype_is_{t.lower()}": flag(query_type == t) for t in ("TXT", "NULL", "MX")}}


def tunnel_reason(f: dict[str, Column], threshold: float = 4.2, rate: Column | None = None) -> Column:
    """First heuristic of tunnelling that holds, else null."""
    out = F.when(f["dns_shannon_entropy"] > threshold, "entropy").when(f["dns_max_label_len"] > 52, "label_length")
    out = out.when((f["dns_vowel_ratio"] < 0.03) & (f["dns_query_len"] > 30), "vowels").when(f["dns_matches_tunnel_pattern"] == 1, "pattern")
    return out if rate is None else out.when(rate > 200, "rate")


def tunnel_probability(p: Column, entropy: Column, max_label: Column, digits: Column) -> Column:
    """The model's probability, raised for long labels of high entropy."""
    raised = F.greatest(p, F.least(F.lit(0.97), F.lit(0.60) + F.lit(0.15) * (entropy - 4) + F.lit(0.20) * digits))
    return F.when((entropy > 4) & (max_label > 30), raised).otherwise(p)


def md5_bucket(key: Column, n: int = 10) -> Column:
    """int(md5(key), 16) % 10 from its two halves; 16 ** 16 leaves 6 modulo 10."""
    if n != 10:
        raise ValueError("the halves are combined for n = 10")
    half = lambda at: F.conv(F.substring(F.md5(key), at, 16), 16, 10).cast("decimal(20,0)") % 10
    return ((half(1) * 6 + half(17)) % 10).cast("int")
