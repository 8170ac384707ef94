"""Personal data: high-recall generators propose overlapping spans, boosted trees weigh their format and context, calibrated thresholds select.

Everything on the data's path is column expressions: matches and the gaps between them come from regular expressions in the row, offsets (code
points) from a running sum over a document's matches, trees are CASE expressions.  Only a table of distinct feature values with counts, bounded
by FEATURE_ROWS, comes to the driver, where the trees are grown.

Base kinds (email, ip, card, phone) are proposed by their generators and always selected where their format holds.  Labels to learn from are
formats that prove themselves: checksums (of account numbers too) and ranges (of social security numbers too) that hold or fail, secrets behind an assignment, keys with a fixed prefix.  The trees see the
match's shape and what stands around it, not the proof, so they carry over to proposals without one.  Thresholds are set by kind group on
held-out documents, at the least score whose selections are right in PRECISION of cases; a kind whose held-out labels are none, or all 0, needs
ALONE, and more than any of those.  An account number is selected if its check digits hold and a social security number only if its ranges do: by
a cue before it, or by its score.

Defined results: null and empty texts have no spans; equal spans of several kinds all count and are redacted once, under the kind listed first;
repeated rows each get their own result; an empty table gives an empty one; other columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import settle

BASE = ("email", "ip", "card", "phone")
#: Kind: (what a text must hold to be searched, pattern).  Possessive repeats match the same and don't recurse on long runs; an e-mail begins
#: where its run of characters does or where the last match ended, which is what leftmost matching finds.
GENERATORS = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"\.[0-9]", r"[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "account": (r"[A-Z]{2}[0-9]", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "key": (r"[0-9]", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"),
    "local_phone": (r"[0-9]{3}[ -]?[0-9]{4}", r"(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"),
    "number": (r"[0-9]-?[0-9]", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b|\b[0-9]{9,15}\b"),
    "spelled_email": (r"(?i)[ (\[]dot[ )\]]", r"(?i)\b[a-z0-9._%+-]{2,64} (?:at|\(at\)|\[at\]) [a-z0-9-]{2,64}(?: (?:dot|\(dot\)|\[dot\]) [a-z]{2,10})+\b"),
}
KINDS = tuple(GENERATORS)
ACCOUNT, NUMBER = KINDS.index("account"), KINDS.index("number")
#: Numbers of the form 3-2-4 have a threshold of their own, under this number.
SSN = len(KINDS)
#: Areas, groups and serials that no social security number has.
NO_SSN = r"^(?:000|666|9)|-00-|-0000$"
BEFORE, AFTER = 24, 8
CUES = r"(?i)(?:token|password|passwd|secret|api.?key|access.?key|credential)\W{0,6}$"
CONTACT_CUES = r"(?i)(?:mail|phone|tel|call|fax|contact|mobile|iban|account|card|ssn|ip|address)\W{0,4}$"
#: Distinct feature values that come to the driver at most; the most frequent, by count, if there are more.
FEATURE_ROWS = 50_000
FEATURES = ("f_kind", "f_size", "f_digits", "f_upper", "f_marks", "f_cue", "f_joined", "f_mixed")
TREES, DEPTH, RATE, PRECISION, ALONE = 24, 3, 0.4, 0.95, 0.9


def _proposals(text: Column) -> Column:
    """Array of (kind, i, gap, match, before, after) over all kinds, in the row; a kind is searched only where its cheap test holds."""

    def of(number: int, kind: str) -> Column:
        test, pattern = GENERATORS[kind]
        gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

        def one(match: Column, i: Column) -> Column:
            gap, after = F.get(gaps, i), F.get(gaps, i + 1)
            return F.struct(
                F.lit(number).alias("kind"), i.alias("i"), F.length(gap).cast("long").alias("gap"), match.alias("match"),
                F.right(gap, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"),
            )

        nothing = F.array().cast("array<struct<kind:int,i:int,gap:bigint,match:string,before:string,after:string>>")
        return F.when(text.contains("@") if kind == "email" else text.rlike(test), F.transform(found, one)).otherwise(nothing)

    return F.concat(*(of(n, k) for n, k in enumerate(KINDS)))


def _digits(column: str) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def _valid() -> Column:
    """Whether a base kind's match holds by its format; null for other kinds."""
    parts = F.transform(F.split("match", r"\.", -1), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    size = F.length(_digits("match"))
    card = size.between(16, 19) & F.expr("luhn_check(regexp_replace(match, '[^0-9]', ''))")
    return F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, ip).when(F.col("kind") == 2, card).when(F.col("kind") == 3, size.between(8, 15))


def _iban() -> Column:
    """Whether an account number's check digits hold: from its fifth sign on and then the first four, letters as 10 to 35, it is 1 modulo 97."""
    signs = F.regexp_replace("match", " ", "")
    turned = F.regexp_extract_all(F.concat(F.substring(signs, 5, 40), F.substring(signs, 1, 4)), F.lit("."), F.lit(0))
    add = lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return (F.length(signs) >= 15) & (F.aggregate(turned, F.lit(0), add) == 1)


def _label() -> Column:
    """1 and 0 where a proposal proves or disproves itself, else null."""
    kind, match, before = F.col("kind"), F.col("match"), F.col("before")
    secret = before.rlike(CUES) | match.rlike("^AKIA[0-9A-Z]{16}$")
    plain = ~before.rlike(CUES) & match.rlike("^[0-9]+$|^[A-Za-z]+[0-9]{1,4}$")
    return (
        F.when(kind <= 3, F.col("valid").cast("int"))
        .when((kind == KINDS.index("key")) & secret, 1)
        .when((kind == KINDS.index("key")) & plain, 0)
        .when((kind == KINDS.index("local_phone")) & before.rlike(r"\+1[ -]?$|(?i)(?:phone|tel|call|fax|mobile)\W{0,4}$"), 1)
        .when((kind == NUMBER) & match.rlike("^[0-9]{9,}$") & ~before.rlike(CONTACT_CUES), 0)
        .when((kind == NUMBER) & match.contains("-"), (~match.rlike(NO_SSN)).cast("int"))
        .when(kind == ACCOUNT, _iban().cast("int"))
    )


def _features() -> dict[str, Column]:
    """Small whole numbers: the tables of the trees stay small and so does what the driver sees."""
    match, before, after, size = F.col("match"), F.col("before"), F.col("after"), F.length("match")
    share = lambda pattern: F.floor(4 * F.length(F.regexp_replace("match", pattern, "")) / F.greatest(size, F.lit(1))).cast("int")
    return {
        "f_kind": F.col("kind"),
        "f_size": F.when(size < 8, 0).when(size < 12, 1).when(size < 15, 2).when(size < 17, 3).when(size < 20, 4).when(size < 33, 5).otherwise(6),
        "f_digits": share("[^0-9]"),
        "f_upper": share("[^A-Z]"),
        "f_marks": F.least(F.length(F.regexp_replace("match", "[A-Za-z0-9]", "")), F.lit(5)),
        "f_cue": F.when(before.rlike(CUES), 2).when(before.rlike(CONTACT_CUES), 1).otherwise(0),
        "f_joined": (before.rlike(r"[\p{L}\p{N}]$").cast("int") + 2 * after.rlike(r"^[\p{L}\p{N}]").cast("int")),
        "f_mixed": (match.rlike("[0-9]") & match.rlike("[A-Za-z]")).cast("int"),
    }


def propose(docs: DataFrame) -> DataFrame:
    """One row for each proposal, and one with a null kind for a document without any: ``(_row, doc_id, _hash, kind, start, end, valid, label, f_*)``."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_hash"), _proposals(F.coalesce(F.col("text"), F.lit(""))).alias("_c"))
    each = rows.select("_row", "doc_id", "_hash", F.explode_outer("_c").alias("_c")).select("_row", "doc_id", "_hash", "_c.*")
    order = Window.partitionBy("_row", "kind").orderBy("i")
    ends = F.sum(F.col("gap") + F.length("match")).over(order)
    placed = each.withColumn("end", ends).withColumn("start", F.col("end") - F.length("match")).withColumn("valid", _valid()).withColumn("label", _label())
    features = [F.when(F.col("kind").isNotNull(), c).cast("int").alias(n) for n, c in _features().items()]
    return placed.select("_row", "doc_id", "_hash", "kind", "start", "end", "valid", "label", *features)


class Trees:
    """Boosted trees over whole-number features, as nested (feature, bound, low, high) or leaf values."""

    def __init__(self, base: float, trees: list):
        self.base, self.trees, self.bounds = base, trees, {}

    def column(self) -> Column:
        """The score as a CASE expression of the feature columns."""

        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, bound, low, high = node
            return F.when(F.col(name) <= bound, of(low)).otherwise(of(high))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))

    def score(self, row: dict) -> float:
        total = self.base
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return 1 / (1 + math.exp(-total))


def grow(rows: list[dict], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Gradient boosting with logistic loss on weighted rows ``{feature: int, label, n}``."""
    positive, total = sum(r["n"] for r in rows if r["label"]), sum(r["n"] for r in rows)
    base = math.log((positive + 1) / (total - positive + 1))
    scores, made = [base] * len(rows), []

    def split(at: list[int], grad: list[float], hess: list[float], left: int):
        g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
        best, choice = 1e-6, None
        for name in FEATURES if left else ():
            sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for i in at:
                s = sums[rows[i][name]]
                s[0] += grad[i]
                s[1] += hess[i]
            gl = hl = 0.0
            for value in sorted(sums)[:-1]:
                gl, hl = gl + sums[value][0], hl + sums[value][1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > best:
                    best, choice = gain, (name, value)
        if choice is None:
            return rate * g / (h + 1)
        name, bound = choice
        low, high = [i for i in at if rows[i][name] <= bound], [i for i in at if rows[i][name] > bound]
        return name, bound, split(low, grad, hess, left - 1), split(high, grad, hess, left - 1)

    for _ in range(trees if rows else 0):
        chance = [1 / (1 + math.exp(-s)) for s in scores]
        grad = [r["n"] * (r["label"] - p) for r, p in zip(rows, chance, strict=True)]
        hess = [r["n"] * p * (1 - p) for r, p in zip(rows, chance, strict=True)]
        tree = split(list(range(len(rows))), grad, hess, depth)
        made.append(tree)
        one = Trees(0.0, [tree])
        for i, r in enumerate(rows):
            p = one.score(r)
            scores[i] += math.log(p / (1 - p))
    return Trees(base, made)


def fit(proposals: DataFrame) -> Trees:
    """Trees from the proposals with a label, thresholds by kind from the third of documents that the trees weren't grown on."""
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).cast("int").alias("fold")
    counts = proposals.where(F.col("label").isNotNull()).groupBy(*FEATURES, "label", fold).agg(F.count(F.lit(1)).alias("n"))
    rows = [r.asDict() for r in counts.orderBy(F.desc("n"), *FEATURES, "label", "fold").limit(FEATURE_ROWS).collect()]
    trees = grow([r for r in rows if not r["fold"]])
    for number in range(len(KINDS) + 1):
        of = [r for r in rows if r["fold"] and (SSN if r["f_kind"] == NUMBER and r["f_marks"] else r["f_kind"]) == number]
        kept = sorted(((trees.score(r), r["label"], r["n"]) for r in of), reverse=True)
        right = every = 0
        bound = 1.01 if any(label for _, label, _ in kept) else max([ALONE, *(score + 1e-9 for score, _, _ in kept)])
        for i, (score, label, n) in enumerate(kept):
            right, every = right + n * label, every + n
            if right >= PRECISION * every and (i + 1 == len(kept) or kept[i + 1][0] < score):
                bound = max(score, 0.5)
        trees.bounds[number] = bound
    return trees


def selected(proposals: DataFrame, trees: Trees) -> DataFrame:
    """``proposals`` with ``score`` and ``chosen``: base kinds whose format holds, and others from their kind's threshold on."""
    group = F.when((F.col("kind") == NUMBER) & (F.col("f_marks") > 0), SSN).otherwise(F.col("kind"))
    bound = F.lit(ALONE)
    for number, value in trees.bounds.items():
        bound = F.when(group == number, value).otherwise(bound)
    scored = proposals.withColumn("score", F.when(F.col("kind").isNotNull(), trees.column()))
    holds = F.col("label") == 1
    chosen = (
        F.when(F.col("kind") <= 3, F.col("valid"))
        .when(F.col("kind") == ACCOUNT, holds)
        .when(group == SSN, holds & ((F.col("f_cue") == 1) | (F.col("score") >= bound)))
        .otherwise(F.col("score") >= bound)
    )
    return scored.withColumn("chosen", F.coalesce(chosen, F.lit(False)))


def find(docs: DataFrame) -> DataFrame:
    """The proposals of ``docs`` with the trees' decision.  They are written once: the trees are fitted on them and applied to them."""
    proposals = settle(propose(docs), "proposals")
    return selected(proposals, fit(proposals))


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document."""
    kinds = F.array(*map(F.lit, KINDS))
    name = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    span = F.when(F.col("chosen"), F.struct("kind", "start", "end"))
    counts = [F.count_if(F.col("chosen") & (F.col("kind") == n)).alias(f"n_{k}") for n, k in enumerate(BASE)]
    summed = find(docs).groupBy("_row").agg(F.first("doc_id").alias("doc_id"), *counts, F.array_sort(F.collect_list(span)).alias("_spans"))
    base = F.array_join(F.transform(F.filter("_spans", lambda s: s["kind"] <= 3), name), ",")
    return summed.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("_spans", name), ",").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every chosen span replaced by its kind in square brackets; all other columns as they were.

    Documents without proposals never leave their rows; the others meet their spans by id and text.
    """
    names = docs.columns
    span = F.struct("start", "end", "kind")
    spans = find(docs).where("chosen").groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h")).agg(F.array_sort(F.collect_set(span)).alias("_spans"))
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["upto"]
        piece = F.array(F.substring(F.col("text"), (a["upto"] + 1).cast("int"), (s["start"] - a["upto"]).cast("int")), F.get(kinds, s["kind"]))
        return F.struct(F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"), F.greatest(a["upto"], s["end"]).alias("upto"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("upto"))
    rebuilt = F.aggregate("_spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), (a["upto"] + 1).cast("int"), F.lit(2_147_483_647))))
    has = F.size(_proposals(F.coalesce(F.col("text"), F.lit("")))) > 0
    joined = docs.where(has).join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left")
    changed = joined.select(*(F.when(F.col("_spans").isNull(), F.col("text")).otherwise(rebuilt).alias("text") if c == "text" else F.col(c) for c in names))
    return docs.where(~has).unionByName(changed)
