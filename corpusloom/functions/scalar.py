"""Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963985


def ratio(a: Column, b: Column) -> Column:
    """Null where ``b`` is 0 or null."""
    return F.when(b != 0, a / b)


def url_norm(url: Column) -> Column:
    """Without scheme, ``www.`` and outer slashes; case, query and fragment stay."""
    return F.btrim(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"^www\.", ""), F.lit("/"))


def domain_of(norm: Column) -> Column:
    return F.nullif(F.regexp_extract(norm, "^([^/]+)", 1), F.lit(""))


def quoted(phrase: Column) -> Column:
    """A regex that matches the phrase literally."""
    return F.regexp_replace(phrase, r"([^\p{L}\p{N}\s])", r"\\$1")


def _bounded(phrase: Column) -> Column:
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted(phrase), F.lit(r"(?![\p{L}\p{N}])"))


def whole_phrase(text: Column, phrase: Column) -> Column:
    """Whether ``phrase`` stands in ``text`` with no letter or digit at either side."""
    return F.rlike(text, _bounded(phrase))


def phrase_place(text: Column, phrase: Column) -> Column:
    """Where ``phrase`` first stands whole in ``text``, from 1; 0 if nowhere."""
    return F.regexp_instr(text, _bounded(phrase))


def seeded(seed: int, key: Column) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def least_strict(*cols: Column) -> Column:
    """Least value; null if any is null (``least`` skips nulls)."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(known, F.least(*cols))


def wilson(p: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; nulls for n <= 0."""
    centre, spread = p + z * z / (2 * n), z * F.sqrt(F.greatest(p * (1 - p) / n + z * z / (4 * n * n), F.lit(0.0)))
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n))), F.when(ok, F.least(F.lit(1.0), (centre + spread) / (1 + z * z / n)))


def kish(weights: Column) -> Column:
    """Aggregate: effective size of a weighted sample."""
    return ratio(F.sum(weights) * F.sum(weights), F.sum(weights * weights))


def entropy(p: Column, eps: float = 1e-10) -> Column:
    """Bits of a two-class probability, clipped to [eps, 1 - eps]."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def margin(p: Column) -> Column:
    return 1 - F.abs(2 * p - 1)


def least_confident(p: Column) -> Column:
    return 2 * (1 - F.greatest(p, 1 - p))


def hex_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes; halves avoid the sign of a 64-bit number."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def language(code: Column) -> Column:
    """Blank becomes ``unknown``; regional Chinese codes become one."""
    low = F.lower(F.trim(code))
    return F.when(low.isNull() | (low == ""), "unknown").when(low.isin("zh-tw", "zh-hk"), "zh-cn").otherwise(low)


def json_object(text: Column) -> Column:
    """The JSON object in a reply: from the first brace to the last closing one up to which it parses; null if none.

    The parser overlooks what follows a value, so a span counts only if it parses both as an array's one element and as
    an object's one member: no tail is right in both places.
    """
    parts = F.split(F.regexp_extract(text, r"(?s)(\{.*)\}", 1), r"\}")
    span = lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "}"), F.lit("}"))
    whole = lambda x: F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), x, F.lit("}"))).isNotNull()
    tries = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    return F.aggregate(tries, F.lit(None).cast("string"), lambda found, n: F.coalesce(found, F.when(whole(span(n)), span(n))))


def strict_bool(body: Column, name: str) -> Column:
    """A real JSON boolean, else null: strings and numbers are not coerced."""
    v = F.try_parse_json(body)
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean"))


def download_verdict(sha_got: Column, sha_want: Column, hash_got: Column, hash_want: Column, most_bits: int = 2) -> Column:
    """ok: same bytes; recoded: other bytes, same picture; changed: another picture; failed: nothing came."""
    near = hex_distance(hash_got, hash_want) <= most_bits
    return F.when(sha_got.isNull(), "failed").when(sha_got == sha_want, "ok").when(near, "recoded").otherwise("changed")


def http_status(code: Column, error: Column) -> Column:
    """alive: below 400; dead: 400 and above, or a time-out; error: anything else."""
    return F.when(code < 400, "alive").when(code >= 400, "dead").when(error == "timeout", "dead").otherwise("error")


# US dollars per million tokens, of input, output, cache reads and cache writes, by tier of model.
RATES = {"small": (1.0, 5.0, 0.1, 1.25), "large": (3.0, 15.0, 0.3, 3.75)}


def cost(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, rates: tuple[float, float, float, float]) -> Column:
    """US dollars by rates per million tokens."""
    return (tokens_in * rates[0] + tokens_out * rates[1] + cache_read * rates[2] + cache_write * rates[3]) / F.lit(1e6)


def tier_cost(model: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column) -> Column:
    """Cost by the tier that a model's name tells: haiku is small, sonnet and all others large."""
    each = {name: cost(tokens_in, tokens_out, cache_read, cache_write, rates) for name, rates in RATES.items()}
    return F.when(F.contains(F.lower(model), F.lit("haiku")), each["small"]).otherwise(each["large"])


def host_domain(url: Column) -> Column:
    """The network location with every ``www.`` taken out; port and user stay; empty without scheme."""
    return F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


# Names of the languages that texts are counted by.
LANGUAGES = {
    "en": "English", "fr": "French", "de": "German", "ko": "Korean", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "ru": "Russian", "ja": "Japanese", "zh-cn": "Chinese", "ar": "Arabic", "tr": "Turkish",
    "sv": "Swedish", "da": "Danish", "no": "Norwegian", "fi": "Finnish", "cs": "Czech", "ro": "Romanian", "hu": "Hungarian", "uk": "Ukrainian", "vi": "Vietnamese", "id": "Indonesian", "unknown": "Unknown",
}


def language_name(code: Column) -> Column:
    """A language's name; a code without one stays as it is."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), code), code)


def phrase_key(phrase: Column) -> Column:
    return F.lower(F.replace(phrase, F.lit(" "), F.lit("_")))


def verdict_flag(answer: Column) -> Column:
    """YES and NO as 1 and 0; anything else, INVALID too, is null and to be dropped."""
    return F.when(answer == "YES", 1).when(answer == "NO", 0)


def as_bool(number: Column) -> Column:
    """1 and 0 as true and false; any other number and null are null."""
    return F.when(number == 1, True).when(number == 0, False)


def download_status(code: Column, size: Column, decoded: Column, image_format: Column, error: Column, most_mb: int = 20, accepted: tuple[str, ...] = ("JPEG", "PNG", "GIF", "WEBP", "BMP", "TIFF")) -> Column:
    """failed: an error, a code but 200, or too large; not_image: doesn't decode, or no accepted format; else success."""
    bad = error.isNotNull() | code.isNull() | (code != 200) | (size > most_mb * 1024 * 1024)
    return F.when(bad, "failed").when(~F.coalesce(decoded & image_format.isin(*accepted), F.lit(False)), "not_image").otherwise("success")


# File extensions by format, of stored images and of fetched ones, with what other formats get.
STORED = ({"JPEG": ".jpg", "PNG": ".png", "GIF": ".gif", "WEBP": ".webp", "BMP": ".bmp", "TIFF": ".tiff"}, ".jpg")
FETCHED = ({"JPEG": ".jpg", "PNG": ".png", "WEBP": ".webp", "BMP": ".bmp"}, ".img")


def extension(image_format: Column, table: tuple[dict[str, str], str] = STORED) -> Column:
    names, other = table
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), image_format), F.lit(other))


def retry_verdict(code: Column, message: Column, attempt: Column, attempts: int) -> Column:
    """What to do after a failed attempt (numbered from 0): ``wait`` after a limit was hit (429, 529, overloaded), ``again``
    after a passing fault (408, 425, 5xx, a time-out), ``error`` after any other or the last attempt.
    """
    low = F.lower(F.coalesce(message, F.lit("")))
    limited = code.isin(429, 529) | F.contains(low, F.lit("rate_limit")) | F.contains(low, F.lit("overloaded"))
    passing = code.isin(408, 425) | code.between(500, 599) | F.contains(low, F.lit("timeout"))
    last = attempt >= attempts - 1
    no = F.lit(False)
    return F.when(last, "error").when(F.coalesce(limited, no) | F.rlike(low, F.lit("429|529")), "wait").when(F.coalesce(passing, no), "again").otherwise("error")


def backoff(attempt: Column, base: float = 1.0) -> Column:
    """Seconds before the next attempt: doubled each time."""
    return base * F.pow(F.lit(2.0), attempt)


def utc_stamp(at: Column) -> Column:
    """ISO time to the second, in UTC where the session's zone is."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def score_class(score: Column) -> Column:
    """Nine classes of a score that is a multiple of a half and at least -1."""
    at = lambda v, name: (score == v, name)
    cases = [at(-1, "-1"), at(-0.5, "-0.5"), at(0, "0"), at(0.5, "0.5"), at(1, "1"), ((score > 1) & (score <= 2), "1 to 2"), ((score > 2) & (score <= 5), "2 to 5"), ((score > 5) & (score <= 10), "5 to 10")]
    return reduce(lambda out, c: F.when(*c) if out is None else out.when(*c), cases, None).otherwise("10+")
