"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's target is a share of its words: p = target / source size, 0 to 2. Every document is taken floor(p) times; one more copy
goes to documents drawn with the fractional rest as inclusion probability, balanced within the source on words and on documents.
Flight phase: three undecided documents at a time, the vector of their probabilities moves along the null space of the two
constraints until one of them becomes 0 or 1; it leaves and the next one comes in. A block of bounded size leaves at most two
undecided; those of all blocks of a source fly again in fewer blocks until a single block is left, whose last two or fewer
documents are landed together, on the choice that is nearest to what is left of words and documents.

Draws come from hashes of the documents' keys and the seed, so reruns agree whatever the partitioning.

Defined results: null and blank texts have size 0 (they count as documents); a null source is the last source; documents are told
apart by doc_id, source and size, and rows that agree in these are one unit of their joint size that is taken as a whole; where
doc_id is null, the text's hash stands in. Without words or rows the targets are 0 and nothing is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Units that fly in one task.
BLOCK = 2_000
SEED = 11
EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes; what goes over `cap` times a source's size is dealt out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, active = share * sum(sizes.values()), list(order)
    while active:
        total = sum(weigh[s] for s in active)
        over = [s for s in active if left * weigh[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weigh[s] / total for s in active}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        active = [s for s in active if s not in out]
    return out


def uniform(*parts) -> float:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) / 2.0**64


def fly(p: np.ndarray, words: np.ndarray, docs: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves p (fractions of one source) until at most two are left undecided. Keeps sum(words * p) and sum(docs * p)."""
    p = p.astype(float).copy()
    queue = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    active: list[int] = []
    turn = 0
    for i in queue:
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        # the null space of [[docs], [words]] over three units: their cross product
        u = (docs[b] * words[c] - docs[c] * words[b], docs[c] * words[a] - docs[a] * words[c], docs[a] * words[b] - docs[b] * words[a])
        if not any(u):
            u = (1.0 * docs[b], -1.0 * docs[a], 0.0)
        top = max(map(abs, u))
        u = tuple(x / top for x in u)
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(active, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(active, u, strict=True) if x)
        move = up if draws[turn % len(draws)] * (up + down) < down else -down
        turn += 1
        for k, x in zip(active, u, strict=True):
            p[k] += move * x
            if p[k] <= EPS:
                p[k] = 0.0
            elif p[k] >= 1 - EPS:
                p[k] = 1.0
        active = [k for k in active if 0 < p[k] < 1]
    return p


def land(p: np.ndarray, words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Decides the last ones: of all choices the one nearest in words, then in documents."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    best, choice = None, None
    for bits in range(1 << len(left)):
        take = np.array([(bits >> k) & 1 for k in range(len(left))], dtype=float)
        off = (abs(float(words[left] @ (take - p[left]))), abs(float(docs[left] @ (take - p[left]))), bits)
        if best is None or off < best:
            best, choice = off, take
    out = p.copy()
    out[left] = choice
    return out


def settle(p: np.ndarray, words: np.ndarray, docs: np.ndarray, draws: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Flight and landing of a source's last block. Where one of the landed documents is large, its rounding is paid for by the rest:

    it is held as landed, the others' probabilities are scaled to the words that are left, and they fly again.
    """
    want = float(words @ p)
    small = float(np.median(words[words > 0])) / 2 if (words > 0).any() else 0.0
    held, start, best = np.zeros(len(p), dtype=bool), p, None
    for _ in range(rounds):
        flown = fly(start, words, docs, draws)
        landed = land(flown, words, docs)
        off = abs(float(words @ landed) - want)
        if best is None or off < best[0]:
            best = off, landed
        open_ = (flown > 0) & (flown < 1)
        held |= open_
        free = ~held & (p > EPS) & (p < 1 - EPS)
        mass = float((words * p)[free].sum())
        if off <= small or not open_.any() or mass <= 0:
            break
        fixed = np.where(held, np.where(open_, landed, start), p)
        start = np.where(free, np.clip(p * (want - float((words * fixed)[~free].sum())) / mass, 0, 1), fixed)
    return best[1]


COLUMNS = "key string, doc_id long, source_no long, size long, rows long, source_size long, target double, whole int, p double, blocks long"


def flight(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of one source. The largest fly first, so that the last ones, which must be landed, are small."""
    pdf = pdf.assign(_words=-pdf["size"] * pdf["rows"], _draw=[uniform(SEED, k, s) for k, s in zip(pdf["key"], pdf["size"], strict=True)]).sort_values(["_words", "_draw", "key", "size"], kind="stable")
    words, docs = (pdf["size"] * pdf["rows"]).to_numpy(dtype=float), pdf["rows"].to_numpy(dtype=float)
    draws = np.array([uniform(SEED + 1, k, s) for k, s in zip(pdf["key"], pdf["size"], strict=True)])
    p = (settle if int(pdf["blocks"].iloc[0]) == 1 else fly)(pdf["p"].to_numpy(), words, docs, draws)
    return pdf.drop(columns=["_draw", "_words"]).assign(p=p)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the columns that tell units apart: __w_key, __w_source and __w_size."""
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("h"), F.coalesce(F.hex(F.xxhash64(text)), F.lit(""))))
    return docs.withColumns({"__w_key": key, "__w_source": F.col("source").cast("string"), "__w_size": n_words(text)})


def planned(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sums (source, size, n), a row each, with source_no and target as `targets` has it; only sums over all sources come to the driver.

    Numbers are places in a range sort. A source is capped if left * weight / total > cap * size. As capped sources leave, left / total
    grows, so those capped once stay so, and a round is one aggregate over the written table.
    """
    by = [F.col("source").isNull(), F.col("source")]
    dealt = sums.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = materialize(dealt.select("source", F.col("size").cast("long").alias("size"), "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "sources")
    before, offsets = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    first = F.element_at(F.create_map(*offsets), F.col("part")) if offsets else F.lit(0)
    no = (first + F.col("place")).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(no, F.lit(len(weights))) + 1).cast("int"))
    numbered = dealt.select("source", "size", "n", no.alias("source_no"), weight.alias("weight"))
    most = cap * F.col("size")
    amount = lambda which, what: F.coalesce(F.sum(F.when(which, what)), F.lit(0.0))
    capped, even, known = F.lit(False), F.lit(0.0), -1
    while True:
        r = numbered.agg(F.sum("size").alias("size"), amount(~capped, F.col("weight")).alias("total"), amount(capped, most).alias("gone"), F.count(F.when(capped, 1)).alias("n"), F.count("*").alias("all")).first()
        if r["n"] in (known, r["all"]):
            break
        known = r["n"]
        even = F.lit(float(share * (r["size"] or 0) - r["gone"])) * F.col("weight") / F.lit(float(r["total"]))
        capped = even > most
    return numbered.withColumn("target", F.when(capped, most).otherwise(even))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """A row for each unit: key, doc_id, source, size, rows (of docs), source_size, target, copies (0 to 2)."""
    units = keyed(docs).groupBy(F.col("__w_key").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__w_source").alias("source"), F.col("__w_size").alias("size")).agg(F.count("*").alias("rows"))
    units = materialize(units, "units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.count("*").alias("n"))
    plan = planned(sums, weights, share, cap)
    p = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    whole = F.floor(p + EPS).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")
    plan = plan.select(F.col("source").alias("plan_source"), "source_no", F.col("size").alias("source_size"), "target", whole.alias("whole"), F.greatest(F.lit(0.0), p - whole).alias("p"), blocks.alias("blocks"))
    state = units.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    names = plan.select(F.col("source_no").alias("_no"), F.col("plan_source").alias("source"))
    state = state.select("key", "doc_id", "source_no", "size", "rows", "source_size", "target", "whole", "p", "blocks")
    done = None
    most = plan.agg(F.max("blocks")).first()[0] or 1
    while True:
        dealt = state.withColumn("_block", F.pmod(F.xxhash64("key", "size", F.col("blocks")), F.col("blocks")))
        state = materialize(dealt.groupBy("source_no", "_block").applyInPandas(lambda pdf: flight(pdf.drop(columns="_block")), COLUMNS), "flown")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled = state.where(~open_)
        done = settled if done is None else done.unionByName(settled)
        if most == 1:
            break
        most = max(1, math.ceil(2 * most / block))
        # a block leaves two at most, so the next round needs as many blocks as hold two of each
        state = state.where(open_).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.when(F.col("blocks") > 1, 2 * F.col("blocks")).otherwise(1) / block)).cast("long"))
    copies = (F.col("whole") + F.col("p").cast("int")).alias("copies")
    return done.join(names, F.col("source_no") == F.col("_no")).select("key", "doc_id", "source", "size", "rows", "source_size", "target", copies)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its unit is taken, in its own columns."""
    units = mix(docs.select("doc_id", "source", "text"), **options).where("copies > 0").select(F.col("key").alias("__w_u_key"), F.col("source").alias("__w_u_source"), F.col("size").alias("__w_u_size"), F.col("copies").alias("__w_u_copies"))
    both = keyed(docs).join(units.hint("merge"), (F.col("__w_key") == F.col("__w_u_key")) & F.col("__w_source").eqNullSafe(F.col("__w_u_source")) & (F.col("__w_size") == F.col("__w_u_size")))
    return both.select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__w_u_copies"))).alias("__w_u_copy")).drop("__w_u_copy")


def report(units: DataFrame) -> DataFrame:
    """The digest columns: a row for each row of the documents."""
    one = units.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return one.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
