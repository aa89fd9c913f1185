"""Rules, keyword classification, cascades and routing of messages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textloom.functions import text as X

ABSTAIN = "__abstain__"
#: Below these a model's transaction isn't acted on: where messages are filtered, and in the shared table of labels.
ROUTE_AT, TABLE_AT = 0.65, 0.6
#: (label, words, confidence), the first that has a word in the message wins; callers give their own.
KEYWORDS: tuple[tuple[str, tuple[str, ...], float], ...] = (
    ("finance.bank", ("bank", "konto", "banque", "banco"), 0.9),
    ("life.express", ("parcel", "paket", "colis", "paquete"), 0.88),
    ("transaction.order", ("order", "bestellung", "commande", "pedido"), 0.86),
    ("promotion", ("sale", "rabatt", "promo", "oferta"), 0.84),
    ("spam", ("winner", "gewinn", "gagnez", "premio"), 0.82),
    ("work.meeting", ("meeting", "termin", "réunion", "reunión"), 0.8),
)
DEFAULT = ("transaction.message", 0.55)
SUB_ACTIONS = {
    "orders": ["transaction.order", "travel.ticketing", *(f"life.{x}" for x in "express logistics pickup_code takeaway".split())],
    "reminders": ["travel.transport", *(f"work.{x}" for x in "meeting reminder training".split())],
    "health": ["life.medical"],
    "weather": ["life.weather"],
    "rewards": ["transaction.member", "transaction.points"],
}


def valid_pattern(pattern: str | None) -> bool:
    try:
        return pattern is not None and bool(re.compile(pattern))
    except re.error:
        return False


def first_rule(messages: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """messages (sender, text) with rule_id and action of the first rule that matches: enabled, by priority downwards, then by age.

    A rule's sender and text are {kind, pattern} or absent; both must match. Kinds are exact, prefix, contains and regex,
    without regard to case; a regex that isn't valid matches nothing. Rules are a few, and become one expression without a join.
    """
    sender, text = F.coalesce(F.col("sender"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))

    def matches(c: Column, m: dict | None, plain: Column | None = None) -> Column | None:
        if not m:
            return None
        low, p = F.lower(c), m["pattern"].lower()
        if m["kind"] == "regex":
            return c.rlike(f"(?iu){m['pattern']}") if valid_pattern(m["pattern"]) else F.lit(False)
        if not p:
            return F.lit(False)
        test = {"exact": lambda x, q: x == q, "prefix": lambda x, q: x.startswith(q), "contains": lambda x, q: x.contains(q)}[m["kind"]]
        out = test(low, p)
        return out if plain is None else out | test(F.lower(plain), p.strip().replace("-", "").replace(" ", ""))

    chosen = None
    for r in sorted((r for r in rules if r["enabled"]), key=lambda r: (-r["priority"], r["createdAt"])):
        parts = [m for m in (matches(sender, r.get("sender"), X.sender(sender)), matches(text, r.get("text"))) if m is not None]
        if parts:
            hit = parts[0] if len(parts) == 1 else parts[0] & parts[1]
            value = F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["action"]).alias("action"))
            chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    if chosen is None:
        return messages.withColumns({"rule_id": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    return messages.withColumn("__r", chosen).withColumns({"rule_id": F.col("__r.rule_id"), "action": F.col("__r.action")}).drop("__r")


RULE = "id string, enabled boolean, priority int, sender struct<kind:string, pattern:string>, text struct<kind:string, pattern:string>, action string, createdAt long"
#: Rules up to so many are sent to all tasks as one row.
MOST_RULES = 10_000


def match_rules(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """``first_rule`` with the rules as a table (RULE): those of a user are one row of all tasks, and the first in order that matches is taken; no rows are multiplied."""
    wanted = rules.where("enabled and (sender is not null or text is not null)").select("id", "priority", "sender", "text", "action", "createdAt").limit(MOST_RULES + 1).collect()
    if len(wanted) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    # patterns that aren't valid match nothing, so a rule with one never does
    sound = [r for r in sorted(wanted, key=lambda r: (-r.priority, r.createdAt)) if all(m is None or m.kind != "regex" or valid_pattern(m.pattern) for m in (r.sender, r.text))]
    if not sound:
        return messages.withColumns({"rule_id": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    table = messages.sparkSession.createDataFrame([(r.id, r.sender, r.text, r.action) for r in sound], "id string, s struct<kind:string, pattern:string>, t struct<kind:string, pattern:string>, action string")
    one = table.coalesce(1).agg(F.collect_list(F.struct("id", "s", "t", "action")).alias("__rules"))

    def hit(c: Column, m: Column, plain: Column | None) -> Column:
        low, p = F.lower(c), F.lower(m["pattern"])
        bare = F.translate(F.trim(p), "- ", "")
        test = lambda x, q: F.when(m["kind"] == "exact", x == q).when(m["kind"] == "prefix", F.startswith(x, q)).otherwise(F.contains(x, q))
        some = test(low, p) if plain is None else test(low, p) | test(F.lower(plain), bare)
        return m.isNull() | F.when(m["kind"] == "regex", F.rlike(c, F.concat(F.lit("(?iu)"), m["pattern"]))).otherwise((p != "") & some)

    sender, text = F.coalesce(F.col("sender"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    found = F.get(F.filter("__rules", lambda r: hit(sender, r["s"], X.sender(sender)) & hit(text, r["t"], None)), F.lit(0))
    made = messages.crossJoin(F.broadcast(one)).withColumn("__r", found)
    return made.withColumns({"rule_id": F.col("__r.id"), "action": F.col("__r.action")}).drop("__r", "__rules")


def read_keyword_rules(spark: SparkSession, path: str) -> tuple[tuple[str, tuple[str, ...], float], ...]:
    """Rules for ``keyword_label`` from a JSON list of {label, keywords, confidence}, in their order; a label's rules may come several times, as rules that go first do."""
    rows = spark.read.schema("label string, keywords array<string>, confidence double").option("multiLine", True).option("mode", "FAILFAST").json(path).limit(MOST_RULES).collect()
    if any(r.label is None or not r.keywords or r.confidence is None for r in rows):
        raise ValueError(f"invalid rule in {path}")
    return tuple((r.label, tuple(w.lower() for w in r.keywords), r.confidence) for r in rows)


def decided(messages: DataFrame, rules: Sequence[dict], classifier: Column | None = None, least: float = TABLE_AT, fallback: str = "transaction.other") -> DataFrame:
    """messages with label, confidence, source and action: of the first rule that matches, else of the classifier (label, confidence, source; keywords, unless given).

    A classifier that abstains passes through with no action, and one that isn't sure enough gives the fallback label.
    """
    made = first_rule(messages, rules).withColumn("__d", classifier if classifier is not None else keyword_label(F.col("text")))
    ruled, abstains, weak = F.col("rule_id").isNotNull(), F.col("__d.label") == ABSTAIN, F.col("__d.confidence") < least
    label = F.when(ruled, F.lit(None)).when(abstains, ABSTAIN).when(weak, fallback).otherwise(F.col("__d.label"))
    source = F.when(ruled, "rule").when(abstains, F.col("__d.source")).when(weak, "fallback").otherwise(F.col("__d.source"))
    action = F.when(ruled, F.col("action")).when(abstains | weak, "none").otherwise(route(F.col("__d.label"), base_action(F.col("__d.label")), F.col("__d.confidence"), least))
    return made.withColumns({"label": label.cast("string"), "confidence": F.when(ruled, 1.0).otherwise(F.col("__d.confidence")), "source": source, "action": action}).drop("__d")


def keyword_label(text: Column, rules: Sequence[tuple[str, Sequence[str], float]] = KEYWORDS, default: tuple[str, float] = DEFAULT) -> Column:
    """struct(label, confidence, source): of the first rule with a word in the text, else the default; under 0.65 a fallback of the rest."""
    low, label, sure = F.lower(F.coalesce(text, F.lit(""))), None, None
    for name, words, c in rules:
        hit = low.rlike("|".join(rf"\Q{w}\E" for w in words))
        label = F.when(hit, name) if label is None else label.when(hit, name)
        sure = F.when(hit, c) if sure is None else sure.when(hit, c)
    label, sure = label.otherwise(default[0]), sure.otherwise(default[1])
    weak = sure < 0.65
    return F.struct(F.when(weak, "transaction.other").otherwise(label).alias("label"), sure.alias("confidence"), F.when(weak, "fallback").otherwise("keywords").alias("source"))


def cascade(first: str, second: str, threshold: float = 0.62) -> Column:
    """Of two decisions (label, confidence, source): the first if it abstains, or is no fallback and sure enough; else the second."""
    p = F.col(first)
    return F.when((p["label"] == ABSTAIN) | ((p["source"] != "fallback") & (p["confidence"] >= threshold)), p).otherwise(F.col(second))


def mapped(label: Column, from_rule: Column, mapping: dict[str, str]) -> Column:
    """The label a user maps it to; decisions of rules, promotion and spam stay."""
    out = None
    for a, b in sorted(mapping.items()):
        if a not in ("promotion", "spam"):
            out = F.when(~from_rule & (label == a), b) if out is None else out.when(~from_rule & (label == a), b)
    return label if out is None else out.otherwise(label)


def base_action(label: Column) -> Column:
    """What labels of our taxonomy do: promotion, junk, transaction or none."""
    return F.when(label == "promotion", "promotion").when(label.isin("spam", "scam"), "junk").when(label == ABSTAIN, "none").when(label.isNotNull(), "transaction").otherwise("none")


def route(label: Column, action: Column, confidence: Column, at: float = ROUTE_AT) -> Column:
    return F.when((label == "carrier.promotion") | (action == "promotion"), "promotion").when(action == "junk", "junk").when((action == "transaction") & (confidence >= at), "transaction").otherwise("none")


def sub_action(label: Column, routed: Column) -> Column:
    kind = F.when(label.startswith("finance."), "finance")
    for name, labels in SUB_ACTIONS.items():
        kind = kind.when(label.isin(*labels), name)
    kind = kind.when(label.startswith("carrier."), "carrier").when(label.startswith("government."), "public_services").otherwise("other")
    return F.when(routed == "promotion", F.when(label.isin("carrier.promotion", "promotion"), "offers").otherwise("others")).when(routed == "transaction", kind).otherwise("none")


def engine(requests: DataFrame, budget_ms: int = 500) -> DataFrame:
    """requests with variant and fallback_reason: a rule bypasses models; the transformer answers where it's asked for, supported and in time, else the classic model does."""
    ask = F.col("requested") == "transformer"
    why = F.when(F.col("rule_id").isNotNull() | ~ask, F.lit(None)).when(~F.col("supported"), "unsupported-device").when(F.col("model_error").isNotNull(), F.col("model_error")).when(F.col("latency_ms") > budget_ms, "timeout")
    return requests.withColumn("fallback_reason", why.cast("string")).withColumn("variant", F.when(F.col("rule_id").isNotNull(), "rule").when(ask & F.col("fallback_reason").isNull(), "transformer").otherwise("classic"))


def renumbered(rules: DataFrame) -> DataFrame:
    """Rules in their order with priorities n * 10, (n - 1) * 10 and so on."""
    w = Window.orderBy(F.desc("priority"), "createdAt", "id")
    n = F.greatest(F.count("*").over(Window.partitionBy()), F.lit(1))
    return rules.withColumn("priority", (n * 10 - 10 * (F.row_number().over(w) - 1)).cast("int"))


def next_name(names: DataFrame, stem: str = "Rule ") -> DataFrame:
    """One row: the stem and the number after the greatest in use."""
    n = F.regexp_extract("name", rf"^\Q{stem}\E(\d+)$", 1)
    return names.agg(F.concat(F.lit(stem), (F.coalesce(F.max(F.when(n != "", n.cast("int"))), F.lit(0)) + 1).cast("string")).alias("name"))


def label_from_text(text: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """The label of the first rule (label, words, words that rule it out) that applies, else null: such rows go."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    has = lambda words: low.rlike("|".join(rf"\Q{w}\E" for w in words)) if words else F.lit(False)
    for label, words, veto in rules:
        hit = has(words) & ~has(veto)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(None).cast("string") if out is None else out


def label_from_file(file: Column, text: Column, files: dict[str, str], rules: Sequence[tuple[str, Sequence[str], Sequence[str]]], advertising: dict[str, Sequence[tuple[str, Sequence[str], Sequence[str]]]] | None = None) -> Column:
    """The label that a file's name stands for; in files of advertising, by rules of their own with the file's label as the rest; else by the text's rules. Null where nothing applies: such rows go."""
    out = None
    for name, label in files.items():
        value = F.lit(label)
        if advertising and name in advertising:
            value = F.coalesce(label_from_text(text, advertising[name]), value)
        out = F.when(file == name, value) if out is None else out.when(file == name, value)
    rest = label_from_text(text, rules)
    return rest if out is None else out.otherwise(rest)
