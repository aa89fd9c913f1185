"""Columns and Arrow functions on message texts."""

from __future__ import annotations

import difflib
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

WHITE = r"(?U)\s+"
PLACEHOLDER = r"\{\{[A-Z_]+\}\}"
#: Languages written with spaces, for which a text of one word says too little.
SPACED = tuple("de en es fr id pt ru vi".split())
MARKERS: dict[str, tuple[tuple[str, ...], str]] = {
    "es": (tuple("cuenta código el gracias la las los para pedido tu usted".split()), "¡¿ñ"),
    "pt": (tuple("conta código entrega não obrigado para pedido seu sua você".split()), "çãõ"),
    "fr": (tuple("avec code colis compte est la le les pour votre vous".split()), "çàèê"),
    "de": (tuple("bitte das der die für ihr ihre konto nicht sie und".split()), "ßäöü"),
    "id": (tuple("anda dan dengan kode paket rekening silakan telah untuk yang".split()), ""),
    "vi": (tuple("bạn cho của hàng khoản mã tài và với đơn".split()), "ạảấềểđơư"),
}
SCRIPTS = (("ja", r"[぀-ヿ]"), ("ko", r"[가-힯]"), ("th", r"[฀-๿]"), ("zh", r"[一-鿿㐀-䶿]"), ("ru", r"[Ѐ-ӿ]"))


#: Rows of which an Arrow function makes Python values at a time. A batch has up to 10,000, and their values and results take many times its bytes.
SLICE = 256


def slices(batches: Iterator[pa.Array], width: int = SLICE) -> Iterator[pa.Array]:
    """The rows of the batches in order, so many at a time."""
    for batch in batches:
        for at in range(0, len(batch), width):
            yield batch.slice(at, width)


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


#: Texts of these characters alone are composed already: all that decompose, combine or have another form are left out, and some that don't.
_COMPOSED = r"\x00-\x{2FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3001}-\x{3029}\x{3030}-\x{3096}\x{309B}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF00}-\x{FFEF}"
_COMPATIBLE = r"\x00-\x7F\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{400}-\x{482}\x{48A}-\x{52F}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{20AC}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"


#: What is looked for first, which ends at the first such character.
_SOME_COMPOSED = _SOME_COMPATIBLE = r"[^\x00-\x7F]"


def _normal(text: Column, some: str, plain: str, form) -> Column:
    """The normal form; only texts with other characters than the plain ones, whose form they are, go to Python. That a text is all plain is matched in one run, which is far quicker than to search for another character."""
    other = (F.octet_length(text) > F.length(text)) & text.rlike(some) & ~text.rlike(rf"^[{plain}]*+\z")
    return F.coalesce(form(F.when(other, text)), text)


def nfc(text: Column) -> Column:
    return _normal(text, _SOME_COMPOSED, _COMPOSED, _nfc)


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def normalize(text: Column) -> Column:
    """Composed characters and collapsed white space."""
    return collapse(nfc(text))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is made once however often f has it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def once(value: Column) -> Column:
    """The value as a column that is made once: a projection on top is not merged with this one, which would make it again for every use."""
    return F.explode(F.array(value))


def near_signature(text: Column) -> Column:
    """The first 80 letters and digits in lower case, each run of digits as 0. Of long texts a beginning is enough if it has more than 80 of them."""
    made = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), r"\p{Nd}+", "0"), r"[^\p{L}\p{N}]+", "")
    return F.substring(bound(made(F.substring(text, 1, 400)), lambda head: F.when(F.length(head) > 80, head).otherwise(made(text))), 1, 80)


_WORD = r"[\p{L}\p{N}_]"
_START, _END = rf"(?<!{_WORD})", rf"(?!{_WORD})"
#: What differs from one sending of a template to the next, and what it becomes, in the order in which they are replaced; last a pattern without which there is nothing to replace, where most texts lack it and it is quicker to seek.
TEMPLATE_RULES = (
    (rf"https?://\S+|{_START}{_WORD}[\p{{L}}\p{{N}}_.+-]*+@{_WORD}[\p{{L}}\p{{N}}_.-]*\.[a-z]{{2,}}{_END}", " dynamicurl ", "@|http"),
    (r"^\s*(?:\[[^\]]{1,30}\]|【[^】]{1,30}】|official\s*:|公式\s*[:：])\s*", "", r"^\s*[\[【o公]"),
    (r"(?:reply|txt)\s+stop(?![\p{L}\p{N}_]).*$|回复\s*[a-z]\s*退订.*$|配信停止.*$", "", "stop|退订|配信停止"),
    (rf"{_START}[a-z]{{1,5}}[-_]?[a-z0-9]{{6,}}+{_END}", " dynamicid ", None),
    (r"\p{Nd}+", " dynamicnumber ", None),
    (r"[^\p{L}\p{N}]+", "", None),
)


def template_signature(text: Column) -> Column:
    """The text's letters and digits without what differs from one sending of a template to the next."""
    made = F.lower(_normal(text, _SOME_COMPATIBLE, _COMPATIBLE, _nfkc))
    for pattern, to, needed in TEMPLATE_RULES:
        made = bound(made, _where(needed, pattern, to)) if needed else F.regexp_replace(made, pattern, to)
    return made


def _where(needed: str, pattern: str, to: str) -> Callable[[Column], Column]:
    return lambda t: F.when(t.rlike(needed), F.regexp_replace(t, pattern, to)).otherwise(t)


def detect_language(text: Column) -> Column:
    """By script, and for Latin letters by stop words (1 each) and accents (2 each); en below 2. The first language wins a tie."""
    every = sorted({w for stops, _ in MARKERS.values() for w in stops})

    def score(x: Column) -> Column:
        low, words = x["low"], x["words"]
        scores = []
        for k, (code, (stops, accents)) in enumerate(MARKERS.items()):
            n = F.size(F.array_intersect(words, F.array(*map(F.lit, stops))))
            for a in accents:
                n = n + F.contains(low, F.lit(a)).cast("int") * 2
            scores.append(F.struct(n.alias("score"), F.lit(-k).alias("place"), F.lit(code).alias("code")))
        return F.array_max(F.array(*scores))

    # bound by functions on arrays of one, so that the lower case and its words, of which few matter, are made once for each text that needs them
    found = F.transform(F.array(F.lower(text)), lambda low: F.struct(low.alias("low"), F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)), lambda w: w.isin(*every))).alias("words")))
    best = F.filter(F.transform(found, score), lambda b: b["score"] >= 2)
    latin = F.coalesce(F.get(best, F.lit(0))["code"], F.lit("en"))
    out = None
    for code, pattern in SCRIPTS:
        out = F.when(text.rlike(pattern), code) if out is None else out.when(text.rlike(pattern), code)
    return F.when(text.isNotNull(), out.otherwise(latin))


def core_language(text: Column) -> Column:
    """ja, zh or en."""
    return F.when(text.rlike(SCRIPTS[0][1]), "ja").when(text.rlike(SCRIPTS[3][1]), "zh").when(text.isNotNull(), "en")


def public_language(text: Column) -> Column:
    """ja, ko, zh or en."""
    return F.when(text.rlike(SCRIPTS[0][1]), "ja").when(text.rlike(SCRIPTS[1][1]), "ko").when(text.rlike(SCRIPTS[3][1]), "zh").when(text.isNotNull(), "en")


LANGUAGES = (*SPACED, "ja", "ko", "th", "zh")


def language_hint(hint: Column, allowed: tuple[str, ...] = LANGUAGES) -> Column:
    """The language of a tag such as en_US, with three-letter codes known; unknown if it isn't allowed."""
    code = F.element_at(F.split(F.replace(F.lower(F.trim(hint)), F.lit("_"), F.lit("-")), "-"), 1)
    code = F.when(code == "cmn", "zh").when(code == "eng", "en").when(code == "jpn", "ja").otherwise(code)
    return F.when(code.isin(*allowed), code).otherwise("unknown")


NAMES = {"chinese": "zh", "mandarin": "zh", "japanese": "ja", "english": "en", "spanish": "es", "portuguese": "pt", "french": "fr", "german": "de", "russian": "ru", "korean": "ko", "indonesian": "id", "vietnamese": "vi", "thai": "th"}


def language_name(name: Column) -> Column:
    """The code of the first language whose English name is in the text, else null."""
    return F.coalesce(*(F.when(F.contains(F.lower(name), F.lit(n)), code) for n, code in NAMES.items()))


def informative_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(text), F.lit(1))


def placeholder_only(text: Column) -> Column:
    return text.rlike(PLACEHOLDER) & ~F.regexp_replace(text, PLACEHOLDER, "").rlike(r"[\p{L}\p{N}]")


def junk_reason(text: Column, language: Column, min_length: int = 8, max_length: int = 500) -> Column:
    """The first check that fails, or null."""
    n = F.length(text)
    return (
        F.when(n < min_length, "too-short")
        .when(n > max_length, "too-long")
        .when(informative_share(text) < 0.3, "low-information")
        .when((n > 20) & (F.size(F.array_distinct(F.split(text, ""))) / n < 0.15), "repetitive")
        .when(language.isin(*SPACED) & (F.regexp_count(text, F.lit(r"[\p{L}\p{N}_']+")) < 2), "too-few-words")
        .when(placeholder_only(text), "placeholder-only")
    )


def hash_fraction(*parts: Column) -> Column:
    """The first eight bytes of SHA-256 of the parts, joined by U+001F, as a fraction of 2**64."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p, F.lit("")) for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def sender(text: Column) -> Column:
    return F.translate(F.trim(text), "- ", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def luhn_of_last(number: Column, digits: int) -> Column:
    """Whether the last so many digits of a whole number pass Luhn's check, by arithmetic alone; null for null."""
    digit = lambda k: F.call_function("div", number, F.lit(10**k).cast("long")) % 10
    total = reduce(add, (digit(k) * 2 - F.when(digit(k) > 4, 9).otherwise(0) if k % 2 else digit(k) for k in range(digits)))
    return total % 10 == 0


_ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)


def id_check_digit(digits: Column) -> Column:
    """The eighteenth character of a resident number, of its first seventeen digits; null where they aren't seventeen digits."""
    total = reduce(add, (F.substring(digits, k + 1, 1).cast("int") * w for k, w in enumerate(_ID_WEIGHTS)))
    return F.when(digits.rlike("^[0-9]{17}$"), F.substring(F.lit("10X98765432"), (F.when(digits.rlike("^[0-9]{17}$"), total).otherwise(0) % 11 + 1).cast("int"), F.lit(1)))


def canonical(text: Column) -> Column:
    """For comparing submissions: letters, marks and digits in lower case, each run of digits as one #."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", ""), r"\p{Nd}+", "#")


def shingles(text: Column, width: int = 3) -> Column:
    """Distinct stretches of so many characters. Shifted arrays of characters are joined: substrings by place would be sought from the start each."""
    chars = F.split(text, "")
    made = chars
    for k in range(1, width):
        made = F.zip_with(made, F.slice(chars, k + 1, F.greatest(F.size(chars), F.lit(1))), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.filter(made, lambda g: g.isNotNull()))


def dice(a: Column, b: Column) -> Column:
    """Of two arrays of distinct shingles."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def semantic_change(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 1 - difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


FNV_FEATURES, FNV_TOKENS, _FNV_PRIME = 1469598103934665603, 14695981039346656037, 1099511628211


def fnv1a(data: bytes, basis: int = FNV_FEATURES) -> int:
    for b in data:
        basis = (basis ^ b) * _FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return basis


@F.pandas_udf(T.DecimalType(20, 0))
def fnv64(text: pd.Series) -> pd.Series:
    from decimal import Decimal

    return text.map(lambda t: None if t is None else Decimal(fnv1a(t.encode())))


def ngram_vector(text: str, flags: tuple[bool, ...] = (), dims: int = 512) -> np.ndarray:
    """Counts of hashed character 2- to 4-grams, and flags set to one, at unit length. All grams of a length are hashed at once, byte by byte."""
    out = np.zeros(dims)
    data = np.frombuffer(text.encode(), np.uint8)
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # bytes at which characters begin
    for n in (2, 3, 4):
        starts, ends = first[: max(0, len(first) - n)], first[n:]
        h = np.full(len(starts), FNV_FEATURES, np.uint64)
        for k in range(int((ends - starts).max(initial=0))):
            on = starts + k < ends
            h[on] = (h[on] ^ data[starts[on] + k]) * np.uint64(_FNV_PRIME)
        out += np.bincount((h % np.uint64(dims)).astype(np.int64), minlength=dims)
    for k, on in enumerate(flags):
        if on:
            out[fnv1a(f"flag:{k}".encode()) % dims] = 1
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def hashed_ngrams(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    marks = (("http", "www."), ("code", "otp"), ("stop", "unsubscribe"))
    for texts in slices(batches):
        lowered = (t if t is None else t.lower() for t in texts.to_pylist())
        yield pa.array([None if t is None else ngram_vector(t, tuple(any(m in t for m in some) for some in marks)) for t in lowered], pa.list_(pa.float64()))


def version_at_least(version: Column, least: Column) -> Column:
    """Dotted numbers compared part by part; missing parts are 0."""
    part = lambda v, i: F.coalesce(F.try_element_at(F.split(v, r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(*(part(version, i).alias(f"p{i}") for i in (1, 2, 3))) >= F.struct(*(part(least, i).alias(f"p{i}") for i in (1, 2, 3)))


def compatibility(schema: Column, abi: Column, app: Column, least_app: Column, most_app: Column, system: Column, least_system: Column, release: Column, current: Column, schemas: tuple[int, ...] = (2,), abis: tuple[int, ...] = (2,)) -> Column:
    """Why a release can't be installed, the first reason that applies, or compatible."""
    return (
        F.when(~F.coalesce(schema.isin(*schemas), F.lit(False)), "unsupported-schema")
        .when(~F.coalesce(abi.isin(*abis), F.lit(False)), "unsupported-abi")
        .when(app < least_app, "app-too-old")
        .when(app > most_app, "app-too-new")
        .when(~version_at_least(system, least_system), "system-too-old")
        .when(release < current, "release-rollback")
        .otherwise("compatible")
    )


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_safe_path(path: Column) -> Column:
    """A relative path without empty, . or .. parts."""
    return F.coalesce((F.length(path) > 0) & ~path.rlike(r"(^|/)(\.{0,2})(/|$)") & ~F.contains(path, F.lit("\\")), F.lit(False))


def localized(titles: Column, preferred: list[str]) -> Column:
    """The title in the first preferred language that there is, else zh, en, or the first by code."""
    keys = F.array_sort(F.map_keys(titles))
    return F.coalesce(*(F.try_element_at(titles, F.lit(p)) for p in [*preferred, "zh", "en"]), F.try_element_at(titles, F.try_element_at(keys, F.lit(1))))


class StableRandom:
    """A 64-bit linear congruential generator seeded by SHA-256 of a text."""

    def __init__(self, seed: str):
        self.at = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big") or 0x9E3779B97F4A7C15

    def between(self, low: int, high: int) -> int:
        self.at = 0xFFFFFFFFFFFFFFFF & (1442695040888963407 + 6364136223846793005 * self.at)
        return low + self.at % (high + 1 - low)

    def pick(self, values):
        return values[self.between(0, len(values) - 1)]


def _filled(token: str, language: str, r: StableRandom) -> str:
    """An invented value that no person has."""
    digits = lambda n: "".join(str(r.between(0, 9)) for _ in range(n))
    if token == "PHONE":
        return {"zh": f"199{digits(8)}", "ja": f"090-{digits(4)}-{digits(4)}"}.get(language, f"+1 555 01{digits(2)}")
    if token == "AMOUNT":
        n = r.between(1, 999)
        return {"zh": f"{n}.{digits(2)}元", "ja": f"{n}円"}.get(language, f"${n}.{digits(2)}")
    if token == "ADDRESS":
        n = r.between(1, 199)
        return {"zh": f"和平路{n}号", "ja": f"港区{n}-{r.between(1, 20)}"}.get(language, f"{n} Oak Street")
    if token == "ID":
        return {"zh": "000000190001010000", "ja": "000000000000"}.get(language, "X00000000")
    if token == "PLATE":
        return {"zh": f"京A{digits(5)}", "ja": f"品川 500 あ {digits(2)}-{digits(2)}"}.get(language, f"ABC {digits(4)}")
    if token == "NAME":
        return {"zh": r.pick(["小王", "小李"]), "ja": r.pick(["佐藤", "鈴木"])}.get(language, r.pick(["Alex", "Sam"]))
    return {"URL": f"https://example.com/{digits(6)}", "EMAIL": f"user{digits(3)}@example.com", "CARD": " ".join(digits(4) for _ in range(4)), "ORDER_ID": digits(9), "CODE": digits(6)}.get(token, "{{" + token + "}}")


@F.pandas_udf(T.StringType())
def rehydrate(text: pd.Series, language: pd.Series) -> pd.Series:
    """Placeholders such as {{PHONE}} filled with invented values; the same text always gets the same ones. Unknown tokens stay."""

    def one(t, code):
        if t is None or "{{" not in t:
            return t
        r = StableRandom(t)
        return re.sub(r"\{\{([A-Z_]+)\}\}", lambda m: _filled(m[1], code or "en", r), t)

    return pd.Series([one(t, c) for t, c in zip(text, language, strict=True)])
