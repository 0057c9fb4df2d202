"""Personal data by weak supervision.

Base spans come from four strict patterns (email, ip, card, phone) with their checks. Wider patterns give candidates
besides: matches that fail a check, numbers written like phones without a country code, spelled-out addresses. What
overlaps a base span is no candidate. Labelers vote on every candidate (1 yes, 0 no, -1 abstains): the strict pattern with
its check, a gazetteer (top-level domains, reserved networks, issuer prefixes, calling codes), the words on either side in
four languages, the characters beside it, and the company of base spans in the text. Expectation-maximisation over the
counts of vote patterns estimates each labeler's reliability per kind, and a logistic span classifier is trained on its
posteriors, with the shape of the candidate as further features. Base spans stay; of the other candidates, those that
the classifier accepts are added, patterns that it has not seen included; added spans do not overlap.

Null or empty text: no span. Null id: its row is kept. Very long texts: matches are placed in blocks. Repeated rows: each
gets its own result. Ties in start go by kind as listed. Empty table: empty result and a model of priors. Other columns
are not read. All of it is DataFrame expressions; what reaches the driver is one count per pattern of votes and shapes,
of which there are a few hundred.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "gazetteer", "context", "surroundings", "company")

# Strict patterns, written so that a match starts where a run starts or the match before ended: same matches, one scan.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}+"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
# Wider ones.
SPELLED_EMAIL = "(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\\[(]at[\\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\\[(]dot[\\])]|\\.) ?[A-Za-z0-9-]{1,63}+){1,4}+"
LOCAL_PHONE = "(?<![0-9+().-])(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"

# Fixed values of the gazetteers.
TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl", "us", "ca", "co")
CALLING_CODES = "^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {
    "email": "e-?mails?|mailto|mail|contact|kontakt|correo|courriel|write to|schreib|escrib|écri",
    "ip": "ip|host|server|address|adresse|dirección|direccion|client|remote|serveur|servidor|gateway",
    "card": "card|karte|carte|tarjeta|visa|mastercard|amex|kreditkarte|credit|crédit|crédito|pan",
    "phone": "phone|tel|tél|call|fax|mobile|mobil|handy|telefon|telefono|teléfono|téléphone|telephone|anruf|appel|llam|móvil|portable",
}
AGAINST = "(?:version|release|isbn|order|invoice|ticket|serial|part no|sku|build|rfc|doi|token|sha|hash|id)[ .:=#\"]{0,4}$"


def _found(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, in code points: what stands between the matches gives their places."""
    values, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)
    pairs = F.zip_with(values, gaps, lambda v, g: F.struct(v.alias("v"), g.alias("g")))  # one gap more than values
    return F.element_at(F.transform(F.array(pairs), _placed), 1)


def _placed(zipped: Column) -> Column:
    one = "struct<start:int,end:int,value:string>"

    def step(a: Column, m: Column) -> Column:
        s = a["at"] + F.length(m["g"])
        found = F.struct(s.alias("start"), (s + F.length(m["v"])).alias("end"), m["v"].alias("value"))
        return F.struct(found["end"].alias("at"), F.concat(a["out"], F.array(found)).alias("out"))

    def block(a: Column, first: Column) -> Column:  # lists grow by blocks, so that many matches do not copy one long list each
        own = F.aggregate(F.slice(zipped, first, F.least(F.lit(64), F.size(zipped) - first)), F.struct(a["at"].alias("at"), F.array().cast(f"array<{one}>").alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(a["out"], F.array(own["out"])).alias("out"))

    firsts = F.when(F.size(zipped) > 1, F.sequence(F.lit(1), F.size(zipped) - 1, F.lit(64))).otherwise(F.array().cast("array<int>"))
    blocks = F.aggregate(firsts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{one}>>").alias("out")), block, lambda a: a["out"])
    return F.flatten(blocks)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """12 to 19 digits with a right check digit."""
    figures = F.reverse(F.split(_digits(value), ""))
    figures = F.filter(figures, lambda x: x != "")

    def weight(x: Column, i: Column) -> Column:
        n = x.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    total = F.aggregate(F.transform(figures, weight), F.lit(0), lambda a, x: a + x)
    n = F.length(_digits(value))
    return F.when((n < 12) | (n > 19), False).otherwise(total % 10 == 0)


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        return _luhn(value)
    return F.length(_digits(value)).between(9, 15)


def _gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(*TLDS), 1).otherwise(-1)
    if kind == "ip":
        return F.when(value.rlike("^(?:0|127|2[4-9][0-9]|[3-9][0-9]{2})\\."), 0).otherwise(1)
    if kind == "card":
        issuer = _digits(value).rlike("^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$")
        return F.when(issuer, 1).otherwise(0)
    return F.when(value.rlike(CALLING_CODES), 1).when(value.startswith("+"), 0).otherwise(-1)


def _marker(text: Column, kind: str, strict: bool):
    """What a match becomes: a candidate with its votes and shape."""

    def mark(m: Column) -> Column:
        base = _passes(kind, m["value"]) if strict else F.lit(False)
        before = F.lower(F.substr(text, F.greatest(m["start"] - 47, F.lit(1)), F.least(m["start"], F.lit(48))))
        after = F.lower(F.substr(text, m["end"] + 1, F.lit(32)))
        named = before.rlike(f"(?<![\\p{{L}}\\p{{N}}])(?:{CONTEXT[kind]})[^\\n]{{0,24}}$") | after.rlike(f"^[^\\n\\p{{N}}]{{0,12}}(?<![\\p{{L}}])(?:{CONTEXT[kind]})(?![\\p{{L}}])")
        context = F.when(before.rlike(AGAINST), 0).when(named, 1).otherwise(-1)
        around = F.concat(F.substr(text, m["start"], F.least(m["start"], F.lit(1))), F.substr(text, m["end"] + 1, F.lit(1)))
        loose = F.when(around.rlike("[A-Za-z0-9_=/]"), 0).otherwise(1)
        n = F.length(_digits(m["value"]))
        likely = n.between(12, 19) if kind == "card" else n.between(7, 15) if kind == "phone" else F.lit(True)  # other numbers are no candidates
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"), (base | likely).alias("likely"),
            F.array(base.cast("int"), _gazetteer(kind, m["value"]), context, loose).alias("votes"),
            F.array(F.least(F.floor(n / 4), F.lit(5)).cast("int"), m["value"].rlike("[ ()\\-]").cast("int")).alias("shape"),
        )

    return mark


def _candidates(text: Column) -> Column:
    """All candidates of a text: kind, its number, start, end, votes, shape, base."""
    wide = {
        "email": [(EMAIL, F.contains(text, F.lit("@")), True), (SPELLED_EMAIL, text.rlike("(?i)[\\[(]at[\\])]"), False)],
        "ip": [(IP, text.rlike("[0-9]\\.[0-9]++\\.[0-9]"), True)],
        "card": [(CARD, text.rlike("[0-9](?:[\\x20-]?[0-9]){11}"), True)],
        "phone": [(PHONE, text.rlike("\\+[0-9]"), True), (LOCAL_PHONE, text.rlike("[0-9][ .-][0-9]{4}"), False)],
    }
    kept = "array<struct<kind:int,start:int,end:int,base:boolean,likely:boolean,votes:array<int>,shape:array<int>>>"
    parts = []
    for kind in KINDS:
        for pattern, may, strict in wide[kind]:
            parts.append(F.when(may, F.transform(_found(text, pattern), _marker(text, kind, strict))).otherwise(F.array().cast(kept)))

    def apart(every: Column) -> Column:
        """Candidates that are base or touch no base span, with the vote of the company."""
        base = F.filter(every, lambda c: c["base"])
        return F.element_at(F.transform(F.array(base), lambda b: F.transform(F.filter(every, lambda c: c["base"] | c["likely"] & ~_meets(c, b)), lambda c: voted(c, b))), 1)

    def voted(c: Column, base: Column) -> Column:
        company = F.when(F.size(base) > c["base"].cast("int"), 1).otherwise(-1)
        return c.withField("votes", F.concat(c["votes"], F.array(company)))

    return F.element_at(F.transform(F.array(F.concat(*parts)), apart), 1)


def _meets(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, candidates, other columns to keep) of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, _candidates(text).alias("candidates"), *keep)


@dataclass
class Model:
    """reliability[kind][labeler]: (chance of a yes if personal, if not), of votes cast; accept: probability by pattern;
    weight: of the classifier's features."""

    prior: list[float] = field(default_factory=lambda: [0.5] * len(KINDS))
    reliability: list[list[tuple[float, float]]] = field(default_factory=list)
    accept: dict[tuple, float] = field(default_factory=dict)
    weight: dict[tuple, float] = field(default_factory=dict)


def fit(found: DataFrame, rounds: int = 30, steps: int = 400, rate: float = 0.5) -> Model:
    """EM and the span classifier, from one count per pattern of (kind, votes, shape)."""
    each = found.select(F.explode("candidates").alias("c"))
    counts = each.groupBy("c.kind", "c.votes", "c.shape").count().collect()
    model = Model(reliability=[[(0.8, 0.2)] * len(LABELERS) for _ in KINDS])
    rows = sorted((r[0], tuple(r[1]), tuple(r[2]), r[3]) for r in counts)
    belief: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r[0] == kind]
        for _ in range(rounds if own else 0):
            for _, votes, shape, _n in own:
                yes, no = model.prior[kind], 1 - model.prior[kind]
                for v, (p, q) in zip(votes, model.reliability[kind], strict=True):
                    if v >= 0:
                        yes, no = yes * (p if v else 1 - p), no * (q if v else 1 - q)
                belief[kind, votes, shape] = yes / (yes + no)
            # one pseudo-document a side keeps the estimates off 0 and 1, and the strict labeler's sense fixed
            total = sum(n for *_, n in own)
            mass = sum(n * belief[k, v, s] for k, v, s, n in own)
            model.prior[kind] = min(0.95, max(0.05, (mass + 1) / (total + 2)))
            for j in range(len(LABELERS)):
                cast = [(n, belief[k, v, s], v[j]) for k, v, s, n in own if v[j] >= 0]
                p = (sum(n * b * v for n, b, v in cast) + 8) / (sum(n * b for n, b, _ in cast) + 10)
                q = (sum(n * (1 - b) * v for n, b, v in cast) + 2) / (sum(n * (1 - b) for n, b, _ in cast) + 10)
                model.reliability[kind][j] = (max(p, 0.5), min(q, 0.5)) if j == 0 else (p, q)
    features = {r[:3]: _features(*r[:3]) for r in rows}
    weight: dict[tuple, float] = {}
    total = sum(r[3] for r in rows) or 1
    squares: dict[tuple, float] = {}
    for _ in range(steps):
        slope: dict[tuple, float] = {}
        for k, v, s, n in rows:
            p = 1 / (1 + math.exp(-sum(weight.get(f, 0.0) for f in features[k, v, s])))
            for f in features[k, v, s]:
                slope[f] = slope.get(f, 0.0) + n / total * (p - belief[k, v, s])
        for f, g in slope.items():
            g += 1e-4 * weight.get(f, 0.0)
            squares[f] = squares.get(f, 0.0) + g * g
            weight[f] = weight.get(f, 0.0) - rate * g / math.sqrt(squares[f] + 1e-12)
    model.weight = weight
    model.accept = {k: 1 / (1 + math.exp(-sum(weight.get(f, 0.0) for f in fs))) for k, fs in features.items()}
    return model


def _features(kind: int, votes: tuple, shape: tuple) -> list[tuple]:
    return [(kind,), *((kind, "vote", j, v) for j, v in enumerate(votes)), *((kind, "shape", j, v) for j, v in enumerate(shape))]


def _logit(c: Column, model: Model) -> Column:
    """The classifier's sum for a candidate, with weight 0 for what it has not seen."""
    if not model.weight:
        return F.lit(float("-inf"))
    table = F.create_map(*(F.lit(x) for f, w in sorted(model.weight.items(), key=str) for x in ("|".join(map(str, f)), float(w))))
    of = lambda *parts: F.coalesce(F.try_element_at(table, F.concat_ws("|", c["kind"].cast("string"), *parts)), F.lit(0.0))
    each = lambda name: F.transform(c[name], lambda v, j: of(F.lit({"votes": "vote"}.get(name, name)), j.cast("string"), v.cast("string")))
    return F.aggregate(F.concat(each("votes"), each("shape")), of(), lambda a, x: a + x)


def accepted(found: DataFrame, model: Model, threshold: float = 0.9) -> DataFrame:
    """`found` with base and spans: arrays of (start, kind, end) in order of start and kind. An added span overlaps neither
    a base span nor one that was added before it."""
    one = "array<struct<start:int,kind:int,end:int>>"
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("candidates", lambda c: c["base"]), span))
    least = math.log(threshold / (1 - threshold))
    more = F.array_sort(F.transform(F.filter("candidates", lambda c: ~c["base"] & (_logit(c, model) >= least) & ~_meets(c, F.col("base"))), span))

    def step(a: Column, s: Column) -> Column:
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(s)).alias("out"))).otherwise(a)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(one).alias("out"))
    added = F.aggregate(more, start, step, lambda a: a["out"])
    return found.withColumn("base", base).withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", added))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with <KIND> in place of every span; overlapping spans are replaced together, by the first one's kind."""
    model = fit(candidates(docs, id_col, text_col))
    whole = docs.select(F.struct(*docs.columns).alias("doc"))  # other columns may have any names
    text = F.col(f"doc.{text_col}")
    marked = accepted(whole.withColumn("candidates", _candidates(F.coalesce(text, F.lit("")))), model)
    name = lambda k: F.element_at(F.array(*(F.lit(f"<{x.upper()}>") for x in KINDS)), k + 1)

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], gap, name(s["kind"])).alias("out"))
        inside = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(inside)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    out = marked.select("doc", F.when(F.size("spans") > 0, clean).otherwise(text).alias("clean"))
    renewed = {text_col: F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*(renewed.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns))
