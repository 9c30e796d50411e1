"""Scalar expressions of findings: all of them built-in columns that stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severity ladder, its weights in scores, and the lower bounds of the grades.
SEVERITIES = ("none", "advisory", "warning", "error")
WEIGHTS = {"advisory": 1.5, "warning": 4.0, "error": 8.0}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
# Rules whose findings on one symbol and line share one penalty.
CORRELATED = ("complexity.cognitive", "complexity.cyclomatic", "size.function-length")
PILLARS = ("complexity", "dead-code", "design", "documentation", "maintainability", "modernisation", "naming", "security", "sensitive-data", "size", "test-quality")


def fingerprint(rule: Column, path: Column, line: Column, symbol: Column) -> Column:
    """First 16 hex digits of the SHA-256 of rule, path, line and symbol, joined by a null character; nulls are empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (rule, path, line, symbol)]
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def weight(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, value in WEIGHTS.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def redacted(value: Column) -> Column:
    """A preview of a secret: four characters at either end, or only stars for a short one, and the length."""
    short = F.repeat(F.lit("*"), F.length(value))
    shown = F.when(F.length(value) <= 8, short).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4))))
    return F.concat(shown, F.lit(" (redacted, "), F.length(value).cast("string"), F.lit(" chars)"))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(value, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def card_issuer(digits: Column) -> Column:
    """Issuer of a payment card number by its prefix and length, or null. Prefix ranges are fixed values."""
    n = F.length(digits)
    head = lambda k: F.try_to_number(F.left(digits, F.lit(k)), F.lit("9" * k))
    return (
        F.when(digits.startswith("4") & n.isin(13, 16, 19), "visa")
        .when((head(2).between(51, 55) | head(4).between(2221, 2720)) & (n == 16), "mastercard")
        .when(F.left(digits, F.lit(2)).isin("34", "37") & (n == 15), "amex")
        .when((digits.startswith("6011") | digits.startswith("65") | head(3).between(644, 649)) & n.isin(16, 19), "discover")
        .when((head(3).between(300, 305) | F.left(digits, F.lit(2)).isin("36", "38", "39")) & (n == 14), "diners")
        .when(head(4).between(3528, 3589) & n.between(16, 19), "jcb")
    )


def identifier_words(name: Column) -> Column:
    """Lower-case words of an identifier, split at case changes and at all that is no letter or digit."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def normal_identifier(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def stem(word: Column) -> Column:
    return F.when(word.endswith("s") & (F.length(word) > 3), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def collapsed(path: Column) -> Column:
    """A path without "." and with ".." resolved; what would leave the root stays in front."""
    step = lambda done, part: F.when((part == "") | (part == "."), done).when((part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def annotation_escaped(text: Column, in_property: bool = False) -> Column:
    """Percent-escapes of a workflow command; properties escape colon and comma too."""
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if in_property else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def uri_escaped(path: Column) -> Column:
    """Every segment of a path percent-encoded, the slashes kept."""
    encoded = F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))
    return F.array_join(encoded, "/")
