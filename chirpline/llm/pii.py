"""Personal data in texts, by weak supervision, with DataFrame functions alone.

Patterns propose candidate spans: the base patterns and looser ones. Labelers
vote on each candidate: the strict rule of its kind (form, checksum, ranges), a
gazetteer of well-known endings and prefixes, cue words before the span, and
the span's layout. Expectation-maximisation estimates how reliable each
labeler is for each kind from the counts of the vote patterns, and the
posteriors it gives train a logistic span classifier, which decides on what
the base rules do not take. Base spans always stay.

Secrets are a kind without base rules: long runs of hex digits or of letters
and digits together, known by what they begin with, by words such as "token ="
before them, and by their layout.

The counts are one aggregation over all candidates into at most 5 kinds x 16
votes x 4 sizes; these few rows are all the driver sees.

Places are found without Python: the lengths of the gaps between the matches
of a pattern and of the matches, summed up in two levels, are the code points
before each match.

Defined cases: null texts are empty and have no spans; a text with no candidate
has empty lists; rows that repeat are judged each; other columns are not looked
at; without candidates the classifier takes nothing.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.llm.frames import table, texts_of, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
LOCAL = "[A-Za-z0-9._%+-]"
# Each pattern finds what the plain form in the contract finds, without looking twice at a long run.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}{{2,64}}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "secret": r"(?<![0-9A-Za-z_+/=-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{20,}+(?![+/=])",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# What a text must hold to be searched at all.
GUARDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]+:", "card": r"[0-9][0-9\x20-]{12}", "phone": r"\+[0-9]|[0-9][-.)]", "secret": "[0-9A-Za-z_-]{20}"}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]] ?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|33|34|44|49)[^0-9]|^\(?[2-9][0-9]{2}[).-]",
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|xox[abp]-|eyJ|AIza|glpat-)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel)[^.\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|from)[^.\n]{0,24}$",
    "card": r"(?i)(?:card|visa|master|payment|tarjeta|carte|karte)[^.\n]{0,24}$",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|telefon|llame)[^.\n]{0,24}$",
    "secret": r"(?i)(?:token|secret|passw|pwd|key|auth|bearer|credential)[^.\n]{0,16}$",
}
LAYOUT = {
    "email": r"^[A-Za-z]",
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|:",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$",
    "phone": r"^\+?[0-9]{0,3} ?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$",
    "secret": r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,})$",
}
LABELERS = ("strict", "gazetteer", "cue", "layout")
CHUNK = 128


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def strict(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(14, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def running(values: Column) -> Column:
    """Sums of all values before each, in chunks, so that a long list costs little more than its length."""
    zero = F.lit(0).cast("long")
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    inner = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / CHUNK).cast("int")),
                        lambda c: F.aggregate(F.slice(values, c * CHUNK + 1, F.lit(CHUNK)), F.array(zero), grow))
    before = F.aggregate(F.transform(inner, lambda x: F.element_at(x, -1)), F.array(zero), grow)
    parts = F.zip_with(inner, before, lambda x, b: F.when(x.isNull(), F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + b)))
    return F.when(F.size(values) > 0, F.flatten(parts)).otherwise(F.array().cast("array<bigint>"))


def candidate_columns(kind: str, base: bool) -> Column:
    """Candidates of one pattern from the columns _gap, _match and _before."""
    def one(x):
        m, start = x["_match"], x["_before"] + F.length(x["_gap"])
        rule = strict(kind, m) if base else F.lit(False)
        size = F.least(F.lit(3), F.floor(F.length(m) / 8)).cast("int")
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"),
                        F.lit(base).alias("base"), rule.alias("strict"), m.rlike(GAZETTEER[kind]).alias("gazetteer"),
                        x["_gap"].rlike(CUES[kind]).alias("cue"), m.rlike(LAYOUT[kind]).alias("layout"), size.alias("size"))
    return F.transform(F.arrays_zip("_gap", "_match", "_before"), one)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, the candidates of all patterns with their votes."""
    out = texts_of(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    parts = []
    for base, patterns in ((True, BASE), (False, LOOSE)):
        for kind, pattern in patterns.items():
            name = f"_{kind}_{base}"
            parts.append(name)
            none = F.array().cast("array<string>")
            looked = F.col("text").rlike(GUARDS[kind])
            found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
            out = out.withColumn("_match", F.when(looked, found).otherwise(none))
            out = out.withColumn("_gap", F.when(F.size("_match") > 0, F.slice(F.split("text", pattern, -1), F.lit(1), F.size("_match"))).otherwise(none))
            sizes = F.zip_with("_gap", "_match", lambda g, m: (F.length(g) + F.length(m)).cast("long"))
            out = out.withColumn("_before", running(sizes))
            kept = F.filter(candidate_columns(kind, base), lambda s: s["strict"] | ~s["base"] | (s["end"] - s["start"] >= 7))
            out = out.withColumn(name, kept).drop("_match", "_gap", "_before")
    return out.select("doc_id", F.concat(*parts).alias("spans"))


def vote_counts(found: DataFrame) -> list:
    """The bounded table of (kind, votes, size, base) with the number of candidates of each."""
    one = found.select(F.explode("spans").alias("s")).select("s.kind", "s.size", *(F.col(f"s.{n}").cast("int").alias(n) for n in LABELERS))
    return one.groupBy("kind", "size", *LABELERS).count().collect()


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(rows, rounds=30):
    """Expectation-maximisation over vote patterns: of each kind the share of true spans, and each labeler's rates of yes votes."""
    out = {}
    for kind in range(len(KINDS)):
        own = [(tuple(r[n] for n in LABELERS), r["count"]) for r in rows if r["kind"] == kind]
        share, yes, wrong = 0.5, [0.8] * len(LABELERS), [0.2] * len(LABELERS)
        wrong[0] = 0.05
        for _ in range(rounds):
            posterior = [truth(share, yes, wrong, votes) for votes, _ in own]
            total, true = sum(c for _, c in own) + 2.0, sum(p * c for p, (_, c) in zip(posterior, own)) + 1.0
            share = true / total
            for j in range(len(LABELERS)):
                yes[j] = (sum(p * c for p, (v, c) in zip(posterior, own) if v[j]) + 4 * 0.8) / (true + 4 - 1)
                wrong[j] = (sum((1 - p) * c for p, (v, c) in zip(posterior, own) if v[j]) + 4 * 0.1) / (total - true + 4 - 1)
            yes, wrong = [min(0.999, x) for x in yes], [min(0.999, max(0.001, x)) for x in wrong]
        out[kind] = (share, yes, wrong)
    return out


def truth(share, yes, wrong, votes):
    a = math.log(share / (1 - share)) if 0 < share < 1 else 0.0
    for v, y, w in zip(votes, yes, wrong):
        a += math.log(y / w) if v else math.log((1 - y) / (1 - w))
    return sigmoid(a)


def features(row):
    return [1.0, *(float(row[n]) for n in LABELERS), *(float(row["kind"] == k) for k in range(1, len(KINDS))), row["size"] / 3]


def train_classifier(rows, steps=400, rate=0.5):
    """Weights of a logistic classifier of spans, fitted to the posteriors of the vote patterns."""
    if not rows:
        return None
    rates = reliabilities(rows)
    data = [(features(r), truth(*rates[r["kind"]], tuple(r[n] for n in LABELERS)), math.sqrt(r["count"])) for r in rows]
    total, weights = sum(w for _, _, w in data), [0.0] * len(data[0][0])
    for _ in range(steps):
        step = [0.0] * len(weights)
        for x, target, w in data:
            error = w * (sigmoid(sum(a * b for a, b in zip(weights, x))) - target) / total
            for j, v in enumerate(x):
                step[j] += error * v
        weights = [a - rate * (g + 1e-3 * a) for a, g in zip(weights, step)]
    return weights


def probability(weights, s: Column) -> Column:
    """The classifier's probability of a candidate, as an expression."""
    if weights is None:
        return F.lit(0.0)
    parts = [F.lit(1.0), *(s[n].cast("double") for n in LABELERS), *((s["kind"] == k).cast("double") for k in range(1, len(KINDS))), s["size"] / 3.0]
    logit = sum((F.lit(w) * x for w, x in zip(weights[1:], parts[1:])), F.lit(weights[0]))
    return 1 / (1 + F.exp(-logit))


def find_private(docs: DataFrame, accept: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with base spans and all spans, as sorted arrays of (start, kind, end, score); kind is a place in ``KINDS``."""
    found = written(candidates(docs, id_col, text_col), "pii")
    weights = train_classifier(vote_counts(found))

    def span(s, score):
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), score.alias("score"))

    base = F.transform(F.filter("spans", lambda s: s["base"] & s["strict"]), lambda s: span(s, F.lit(1.0)))
    scored = F.transform(F.filter("spans", lambda s: ~(s["base"] & s["strict"])), lambda s: span(s, probability(weights, s)))
    out = found.select("doc_id", base.alias("base"), F.filter(scored, lambda s: s["score"] >= accept).alias("_more"))
    new = F.filter("_more", lambda s: ~F.exists("base", lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.array_union("base", new)).alias("spans"))


def joined(spans: str) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def op8_pii(spark, sf_dir):
    found = find_private(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    more = lambda s: s["kind"] >= BASE_KINDS
    return found.select("doc_id", *(count(k) for k in range(BASE_KINDS)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
                        F.size(F.filter("spans", more)).cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))
