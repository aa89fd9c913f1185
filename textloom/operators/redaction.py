"""Personal data in messages: spans by pattern and context, merged, and replaced by tokens.

Patterns are our own; phones and links follow them and not a platform's detector, and names aren't
found unless a detector is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from textloom.functions import text as X

PRIORITY = tuple("PHONE URL EMAIL ID PLATE ADDRESS CARD ORDER_ID AMOUNT CODE NAME".split())
SPANS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: Patterns without look-around, which any engine can run.
URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
AMOUNT = r"[$€£¥]\s?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]{1,2})?|[$€£¥]\s?[0-9]+(\.[0-9]{1,2})?"

_I = re.IGNORECASE
_FIND = [
    ("URL", re.compile(URL, _I), 0),
    ("EMAIL", re.compile(EMAIL, _I), 0),
    ("ID", re.compile(r"(?<![0-9])(?:[1-9][0-9]{16}[0-9Xx]|[1-9][0-9]{14})(?![0-9])"), 0),
    ("ID", re.compile(r"passport\s*(?:no\.?|number)?\s*:?\s*([A-Z][0-9]{7,8})", _I), 1),
    ("ADDRESS", re.compile(r"(?:address|deliver(?:ed)? to|收货地址|地址)\s*[:：]\s*([^,;，；\n]{4,60})", _I), 1),
    ("CODE", re.compile(r"(?:code|otp|pin|验证码|認証コード|kode)\D{0,12}?([0-9]{4,8})(?![0-9])", _I), 1),
    ("ORDER_ID", re.compile(r"(?:order|tracking|订单号?|注文番号)\s*(?:no\.?|number|id)?\s*[:：#]?\s*([A-Z0-9-]*[0-9][A-Z0-9-]{5,})", _I), 1),
    ("AMOUNT", re.compile(AMOUNT + r"|(?<![0-9.,])(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]{1,2})?\s?(?:元|円|USD|EUR|GBP|CNY|JPY)(?![A-Za-z])"), 0),
]
_DIGITS = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){14,18}(?![0-9])")
_CARD_WORD = re.compile(r"card|visa|mastercard|卡|カード|karte|carte|tarjeta", _I)
_PHONE = re.compile(r"(?<![0-9])\+?[0-9(][0-9() .-]{5,18}[0-9](?![0-9])")
_PHONE_WORD = re.compile(r"phone|call|tel|mobile|contact|电话|手机|電話|telefon|llama", _I)
_PLATE_CN = re.compile("(?<![A-Z0-9])[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-Z][ ·•・\t-]?[A-Z0-9]{4,5}[A-Z0-9挂学警港澳领](?![A-Z0-9])")
_JP = r"(?:[一-鿿]{1,4}|いわき|つくば|とちぎ|なにわ|袖ヶ浦)[ \t]*[0-9]{1,3}[ \t]*[ぁ-んEHKMTY][ \t]*(?:[0-9]{1,2}-[0-9]{2}|[・･]{1,3}[ \t]*[0-9]{1,3})"
_PLATE_JP = re.compile("(?<![一-鿿])" + _JP + "(?![A-Z0-9])")
#: Forms of number plates: A a letter, 0 a digit, # either, ~ a blank or none, _ blanks.
PLATE_FORMS = {
    "fr": "AA-000-AA", "it": "AA~000~AA", "de": "A{1,3}-A{1,2}_0{1,4}|A{1,3}_A{1,2}_0{1,4}", "es": "0000~AAA", "gb": "AA00~AAA",
    "nl": "AA-00-AA|AA-AA-00|AA-00-00|00-AA-AA|00-AA-00|00-00-AA", "pt": "00-00-AA|00-AA-00|AA-00-00|AA-00-AA", "be": "0-AAA-000|AAA-000", "ch": "AA_0{1,6}",
    "at": "A{1,2}_0{1,5}_A{1,2}", "ie": "0{2,3}-A{1,2}-0{1,6}", "se": "AAA_00#", "no": "AA_0{4,5}", "dk": "AA~00~000", "fi": "A{2,3}-000", "pl": "A{1,3}_#{4,5}", "hk": "A{1,2}~[1-9]0{0,3}|[1-9]0{0,3}",
    "us": "#{1,4}[ -]#{1,5}|(?i:#{2,8})", "any": "#{2,4}[ -]?#{2,5}",
}
#: What is said before a plate, and the countries whose forms may follow; all of them where none is given.
_PLATE_SAID = [
    ("any", "plate|vehicle"),
    ("", r"licen[cs]e plate(?: number)?|plate number|number plate|license tag|vehicle (?:tag|plate|registration(?: number)?)|registration mark|[车車]牌[号號]?|[车車][辆輛][号號]牌|[号號]牌|ナンバー(?:プレート)?|(?:車両|自動車登録|車両登録)番号"),
    ("fr be", r"plaque d['’]immatriculation|immatriculation du véhicule"),
    ("de at ch", r"kfz-kennzeichen|autokennzeichen|kennzeichen des fahrzeugs"),
    ("it", "targa"),
    ("es", r"matr[ií]cula del (?:coche|veh[ií]culo)|placa vehicular"),
    ("pt", r"matr[ií]cula do (?:automóvel|ve[ií]culo)|chapa de matr[ií]cula"),
    ("nl be", "kenteken"),
    ("se no", r"(?:kjøretøyets|fordonets) registreringsnummer"),
    ("dk", r"køretøjets registreringsnummer|nummerplade"),
    ("fi", r"rekisterikilpi|ajoneuvon rekisteritunnus"),
    ("pl", r"tablica rejestracyjna|numer rejestracyjny pojazdu"),
]
#: A clause that names a country takes plates of its form only.
_COUNTRY = [(code, re.compile(words, _I)) for code, words in (("hk", "hong kong|香港"), ("jp", "japan|日本"), ("cn", "mainland china|[中内內大][国國地陆陸]"), ("fr", "france|french"), ("de", "german"), ("it", "ital(?:y|ian)"), ("es", "spain|spanish"), ("gb", "british|united kingdom"), ("nl", "dutch|netherlands"), ("pt", "portug"), ("be", "belgi"), ("ch", "swiss|switzerland"), ("at", "austria"), ("ie", "ireland|irish"), ("se", "swed"), ("no", "norw"), ("dk", "denmark|danish"), ("fi", "finland|finnish"), ("pl", "poland|polish"), ("us", "united states|american|usa"))]
_MARKS = {"A": "[A-Z]", "0": "[0-9]", "#": "[A-Z0-9]", "~": r"[ \t]?", "_": r"[ \t]+"}
# a mask's braces hold counts, which are no marks
_FORM = {code: "(?:" + re.sub(r"\{[^}]*\}|\[[^]]*\]|[A0#~_]", lambda m: _MARKS.get(m[0], m[0]), mask) + ")" for code, mask in PLATE_FORMS.items()} | {"jp": _JP, "cn": _PLATE_CN.pattern}
_PLATE_AFTER = [
    re.compile(f"(?i:{said})" + r"[ \t]*(?i:is|no\.?|number|是|为|は|：|:|#)?[ \t]*[:：]?[ \t]*" + f"({'|'.join(_FORM[c] for c in (codes.split() or _FORM))})(?![A-Z0-9-])")
    for codes, said in _PLATE_SAID
]
_PLATE_HINT = "plate|plade|vehicle|license tag|registration mark|immatriculation|kennzeichen|targa|matr|placa|kenteken|registreringsnummer|rekisteri|rejestracyjn|车牌|車牌|车辆|車輛|号牌|號牌|ナンバー|車両|自動車登録".split("|")
_NOT_PLATE = re.compile(r"flight|gate|seat|room|model|train number|order|product code|campaign|build|航班|座位|房间|车次|订单|产品型号|商品代码|活动编号|构建编号|便名|注文番号|予約番号|製品型番|商品コード|企画番号|ビルド番号", _I)
_CLAUSE = re.compile(r"[,.;!?，。；！？\r\n]")

# what must stand near a span that a model found, for it to count
_CODE_WORD = re.compile(r"one[- ]time (?:code|password)|passcode|otp|(?:verification|security) code|验证码|校验码|动态码|安全码|确认码|一次性(?:密码|口令)|(?:認証|確認)コード|ワンタイムパスワード", _I)
_ORDER_WORD = re.compile(r"(?:order|tracking) (?:id|number)|reservation number|订单(?:编?号)|[运快]递?单号|流水号|取件码|(?:注文|追跡|予約)番号", _I)
_MONEY_SIGN = re.compile(r"[¥￥$€£元块円]|rmb|cny|usd|eur|gbp|jpy", _I)
_MONEY_WORD = re.compile(r"amount|price|total|pa(?:id|yment)|charge|due|cost|金[额額]|[价價][格款]|支付|付款|[应應][还還]|[实實]付|[到入][账賬]|[账帳][单單]|合[计計]|料金|価格|支払|請求|入金", _I)
_COUNTED = re.compile(r"points|score|participants|attendees|views|steps|积分|得分|[参][与加]者|人数|ポイント|スコア", _I)
_COUNTED_AFTER = re.compile(r"\s*(?:[名人件步歩分]|points|participants|attendees|views|steps)", _I)


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _clause(text: str, start: int, end: int) -> str:
    """What stands around a span in its clause, up to 40 characters before and 32 after."""
    return _CLAUSE.split(text[max(0, start - 40) : start])[-1] + " " + _CLAUSE.split(text[end : end + 32])[0]


def _plates(text: str, low: str) -> list[tuple[str, int, int]]:
    """Plates that stand for themselves (China's and Japan's), and those that follow what is said of a plate."""
    strong = [] if text.isascii() else [m.span() for p in (_PLATE_CN, _PLATE_JP) for m in p.finditer(text) if not _NOT_PLATE.search(_clause(text, *m.span()))]
    said = []
    for pattern in _PLATE_AFTER if any(w in low for w in _PLATE_HINT) else ():
        for m in pattern.finditer(text):
            start, end = m.span(1)
            around = _clause(text, start, end)
            codes = [code for code, words in _COUNTRY if words.search(around)]
            if re.search("[0-9]", m[1]) and not _NOT_PLATE.search(_CLAUSE.split(text[max(0, start - 40) : start])[-1]) and (not codes or any(re.fullmatch(_FORM[c], m[1]) for c in codes)):
                said.append((start, end))
    return [("PLATE", *s) for s in strong + said]


def plausible(text: str, token: str, start: int, end: int) -> bool:
    """Whether a span that a model found may count: cards, codes, numbers of orders, phones and amounts need their form and, mostly, words near them; other tokens always may."""
    value = text[start:end]
    digits = re.sub(r"\D", "", value)
    compact = "".join(value.split())
    plain = bool(digits) and re.fullmatch("[A-Za-z0-9-]+", compact) is not None

    def near(pattern: re.Pattern, before: int, after: int) -> bool:
        return pattern.search(text[max(0, start - before) : end + after]) is not None

    if token == "CARD":
        return 16 <= len(digits) <= 19 and (passes_luhn(digits) or near(_CARD_WORD, 20, 12))
    if token == "CODE":
        return plain and 4 <= len(compact) <= 10 and near(_CODE_WORD, 32, 16)
    if token == "ORDER_ID":
        return plain and 4 <= len(compact) <= 24 and near(_ORDER_WORD, 32, 16)
    if token == "PHONE":
        return 7 <= len(digits) <= 15 and ("+" in value or near(_PHONE_WORD, 20, 12) or re.fullmatch("1[3-9][0-9]{9}", digits) is not None)
    if token == "AMOUNT":
        counted = near(_COUNTED, 24, 16) or _COUNTED_AFTER.match(text[end : end + 16]) is not None
        return bool(digits) and not counted and (near(_MONEY_SIGN, 6, 6) or near(_MONEY_WORD, 24, 16))
    return True


def _near(pattern: re.Pattern, text: str, start: int, end: int, reach: int = 24) -> bool:
    return pattern.search(text, max(0, start - reach), min(len(text), end + reach)) is not None


#: What a text must have for a pattern to match: most have none of it, and a look for plain words is far quicker than a pattern.
_SOME_DIGIT, _LONG_NUMBER = re.compile("[0-9]"), re.compile(r"[0-9+(][0-9() .-]{5}")
_NEEDED = {"URL": ("http", "www."), "EMAIL": ("@",), "PASSPORT": ("passport",), "ADDRESS": ("address", "deliver", "地址"), "CODE": ("code", "otp", "pin", "验证码", "認証コード", "kode"), "ORDER_ID": ("order", "tracking", "订单", "注文番号")}


def spans_of(text: str, more: Callable[[str], list[tuple[str, int, int]]] | None = None) -> list[tuple[str, int, int]]:
    """(token, start, end) of what to redact, as found: patterns, and what a detector adds that is plausible."""
    # letters like the Kelvin sign match k without regard to case, and lower case makes them one too
    low = text.lower()
    digit = _SOME_DIGIT.search(text) is not None
    number = digit and _LONG_NUMBER.search(text) is not None
    has = {name: any(w in low for w in some) for name, some in _NEEDED.items()}
    wanted = (has["URL"], has["EMAIL"], number, digit and has["PASSPORT"], has["ADDRESS"], digit and has["CODE"], digit and has["ORDER_ID"], digit)
    out = [(token, m.start(group), m.end(group)) for (token, pattern, group), on in zip(_FIND, wanted, strict=True) if on for m in pattern.finditer(text)]
    if number:
        for m in _DIGITS.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 16 <= len(digits) <= 19 and (passes_luhn(digits) or _near(_CARD_WORD, text, *m.span())):
                out.append(("CARD", *m.span()))
        for m in _PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 7 <= len(digits) <= 15 and (m[0].startswith("+") or re.fullmatch(r"1[3-9][0-9]{9}", digits) or _near(_PHONE_WORD, text, *m.span())):
                out.append(("PHONE", *m.span()))
    if digit:
        out += _plates(text, low)
    return out + [found for found in (more(text) if more else []) if plausible(text, *found)]


def merge_spans(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that overlap or touch become one, with the token that is first in PRIORITY."""
    place = {t: k for k, t in enumerate(PRIORITY)}
    out: list[tuple[str, int, int]] = []
    for token, start, end in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        if out and start <= out[-1][2]:
            t, s, e = out[-1]
            out[-1] = (min(t, token, key=lambda x: place.get(x, len(place))), s, max(e, end))
        else:
            out.append((token, start, end))
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    for token, start, end in reversed(spans):
        text = text[:start] + "{{" + token + "}}" + text[end:]
    return text


def sanitizer(more: Callable[[str], list[tuple[str, int, int]]] | None = None):
    """Arrow function text -> struct(text, spans): whole texts, null for null."""

    kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in X.slices(batches):
            rows = []
            for t in texts.to_pylist():
                found = [] if t is None else merge_spans(spans_of(t, more))
                rows.append({"text": None if t is None else redacted(t, found), "spans": None if t is None else [dict(zip(("token", "start", "end"), s, strict=True)) for s in found]})
            yield pa.array(rows, kind)

    return run


def redact_plain(text: Column) -> Column:
    """Links, addresses of mail and amounts by built-in functions alone."""
    out = F.regexp_replace(text, URL, "{{URL}}")
    out = F.regexp_replace(out, EMAIL, "{{EMAIL}}")
    return F.regexp_replace(out, AMOUNT, "{{AMOUNT}}")
