"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{M}\p{N}_]+"
SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # Unicode's white space, spelt out: faster than its name


def tokens(text: Column) -> Column:
    """Lower-cased words; null gives null."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda x: x != "")


def ngrams(words: Column, n: int, min_length: int = 1) -> Column:
    """Runs of n words joined by spaces: none below ``min_length`` words, one short run below n."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    none = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        size = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(size < max(min_length, 1), none).when(size < n, F.array(F.array_join(w, " "))).otherwise(runs)

    return F.get(F.transform(F.array(words), of), F.lit(0))  # binds the words, else each run would make them anew


def shingle_set(text: Column, n: int, min_length: int = 1) -> Column:
    """The distinct runs of n words of a text."""
    return F.array_distinct(ngrams(tokens(text), n, min_length))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct values; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def normalize(text: Column, strip_punctuation: bool = False) -> Column:
    """For matching: lower case, optionally no punctuation and symbols, white space collapsed."""
    out = F.lower(text)
    if strip_punctuation:
        out = F.regexp_replace(out, r"[\p{P}\p{S}]+", "")
    return F.trim(F.regexp_replace(out, SPACES + "+", " "))


def normalize_web(text: Column) -> Column:
    """For counting web lines: trimmed, lower case, digits as 0, no punctuation, control characters and symbols."""
    trimmed = F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed), r"\p{Nd}", "0"), r"[\p{P}\p{C}\p{S}]+", "")


NEWS_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "-")


def news_text(text: Column) -> Column:
    """For scanned news: hyphenated line breaks joined, lines joined, listed marks and non-ASCII removed."""
    joined = F.replace(F.replace(text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(F.translate(joined, NEWS_MARKS, ""), r"[^\x00-\x7F]", "")


def content_hash(text: Column) -> Column:
    """sha256 of the text in hex."""
    return F.sha2(text, 256)


def little_endian_hash(text: Column, bits: int = 32) -> Column:
    """The first ``bits`` of a text's sha1, read as a little-endian unsigned number (up to 56 bits)."""
    if bits % 8 or not 8 <= bits <= 56:
        raise ValueError("bits must be a multiple of 8 from 8 to 56")
    octets = [F.substring(F.sha1(text), 2 * k + 1, 2) for k in reversed(range(bits // 8))]
    return F.conv(F.concat(*octets), 16, 10).cast("long")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    size = F.length(text)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    total = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(text.isNull(), None).when(size == 0, 0.0).otherwise(total)


def luhn_valid(text: Column) -> Column:
    """Whether a text of digits passes the Luhn check; anything else is false."""
    return F.when(text.isNull(), None).otherwise(text.rlike("^[0-9]+$") & F.coalesce(F.call_function("luhn_check", text), F.lit(False)))
