"""Sequence comparison, distances and clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biomeframe.functions.sequence import MAXIMAL_INFO, MINIMAL_INFO, distance_category, info_count


def site_gap_ratio(seqs: DataFrame, gap: str = "N") -> DataFrame:
    """``msp_name, pos, ratio``: the share of gaps per column, up to the shortest sequence."""
    short = seqs.groupBy("msp_name").agg(F.min(F.length("seq")).alias("_l"))
    # A bounded number of letters per row: sequences explode into positions, partial counts combine before the shuffle.
    rows = seqs.join(F.broadcast(short), "msp_name").select("msp_name", F.posexplode(F.split(F.expr("substring(seq, 1, _l)"), "")).alias("pos", "c")).where("c != ''")
    return rows.groupBy("msp_name", "pos").agg(F.avg(F.when(F.col("c") == gap, 1.0).otherwise(0.0)).alias("ratio"))


def clean_sites(seqs: DataFrame, max_gap: float, min_info_sites: int, gap: str = "N") -> DataFrame:
    """Sequences restricted to columns with at most ``max_gap`` gaps; species with too few such columns go."""
    flags = site_gap_ratio(seqs, gap).groupBy("msp_name").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("ratio") <= max_gap).alias("ok")))).alias("_f"))
    flags = flags.select("msp_name", F.transform("_f", lambda x: x["ok"]).alias("_ok")).where(F.size(F.filter("_ok", lambda x: x)) >= min_info_sites)
    letters = F.array_join(F.filter(F.split("seq", ""), lambda c, i: F.coalesce(F.get("_ok", i), F.lit(False))), "")
    return seqs.join(flags, "msp_name").select(*(letters.alias("seq") if c == "seq" else F.col(c) for c in seqs.columns))


def sequence_info(seqs: DataFrame) -> DataFrame:
    n = F.length("seq")
    low, high = info_count(F.col("seq"), MINIMAL_INFO), info_count(F.col("seq"), MAXIMAL_INFO)
    return seqs.select("msp_name", "sample", n.alias("total_length"), low.alias("noN_info_count"), high.alias("noIUPAC_info_count"),
                       (100.0 * low / F.nullif(n, F.lit(0))).alias("noN_info_pc"), (100.0 * high / F.nullif(n, F.lit(0))).alias("noIUPAC_info_pc"))


#: Letters per word of a bitmap.
_WORD = 60


def _bitmap(seq: Column, letters: str) -> Column:
    """Words of bits that say where the sequence has one of the letters."""
    chunks = F.regexp_extract_all(F.upper(seq), F.lit(f"(?s).{{1,{_WORD}}}"), 0)
    flags = lambda x: F.regexp_replace(F.regexp_replace(x, f"[^{letters}]", "0"), f"[{letters}]", "1")
    return F.transform(chunks, lambda x: F.conv(flags(x), 2, 10).cast("long"))


def _together(a: Column, b: Column) -> Column:
    """Number of positions that are set in both bitmaps."""
    both = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)))
    return F.aggregate(both, F.lit(0), lambda acc, x: acc + x)


def sequence_pairs(seqs: DataFrame) -> DataFrame:
    """Pairs of samples of a species with equally long sequences, once each (sample1 < sample2).

    Each sequence is turned once into bitmaps (of each base, and of the letters with any information), a sixteenth
    to an eighth of a byte per letter and map; pairs carry these, the length and the numbers of informative letters.
    """
    one = seqs.select(
        "msp_name", "sample", F.length("seq").alias("n"), info_count(F.col("seq"), MINIMAL_INFO).alias("low"), info_count(F.col("seq"), MAXIMAL_INFO).alias("high"),
        _bitmap(F.col("seq"), MINIMAL_INFO).alias("any"), *(_bitmap(F.col("seq"), c).alias(c) for c in "ACGT"),
    )
    maps = ["low", "high", "any", *"ACGT"]
    side = lambda k: one.select("msp_name", "n", F.col("sample").alias(f"sample{k}"), *(F.col(c).alias(f"{c}{k}") for c in maps))
    return side(1).join(side(2), ["msp_name", "n"]).where("sample1 < sample2")


def _cell(x: str, y: str) -> Column:
    return _together(F.col(f"{x}1"), F.col(f"{y}2"))


def pairwise_comparison(seqs: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """Thirteen-column comparison per pair; distance and category are null without ``distances``."""
    n = F.nullif(F.col("n"), F.lit(0))
    pc = lambda x: 100.0 * x / n
    low, high = _together(F.col("any1"), F.col("any2")), sum((_cell(x, y) for x in "ACGT" for y in "ACGT"), F.lit(0))
    pairs = sequence_pairs(seqs).withColumn("_low", low).withColumn("_high", high)
    out = pairs.select(
        "msp_name", "sample1", "sample2", F.col("n").alias("total_length"), F.col("_low").alias("overlap_noN_info_count"), F.col("_high").alias("overlap_noIUPAC_info_count"),
        pc(F.col("_low")).alias("overlap_noN_info_pc"), pc(F.col("_high")).alias("overlap_noIUPAC_info_pc"),
        pc(F.col("low1")).alias("noN_info_pc_sample1"), pc(F.col("low2")).alias("noN_info_pc_sample2"), pc(F.col("high1")).alias("noIUPAC_info_pc_sample1"), pc(F.col("high2")).alias("noIUPAC_info_pc_sample2"),
    )
    if distances is None:
        return out.withColumn("distance", F.lit(None).cast("double")).withColumn("distance_category", F.lit(None).cast("string"))
    out = out.join(distances.select("msp_name", "sample1", "sample2", "distance"), ["msp_name", "sample1", "sample2"], "left")
    return out.withColumn("distance_category", F.when(F.col("distance").isNotNull(), distance_category(F.col("distance"))))


def pair_cells(pairs: DataFrame) -> DataFrame:
    """``msp_name, sample1, sample2`` and the number of sites with each pair of bases, as columns AA to TT."""
    return pairs.select("msp_name", "sample1", "sample2", *(_cell(x, y).alias(x + y) for x in "ACGT" for y in "ACGT"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Counts over sites where both bases are A, C, G or T: sites, A<->G, C<->T and other differences, and each base."""
    total = lambda cells: sum((F.col(c) for c in cells), F.lit(0))
    every = [x + y for x in "ACGT" for y in "ACGT"]
    return pair_cells(pairs).select(
        "msp_name", "sample1", "sample2", total(every).alias("sites"), total(["AG", "GA"]).alias("ag"), total(["CT", "TC"]).alias("ct"),
        total(["AC", "CA", "AT", "TA", "GC", "CG", "GT", "TG"]).alias("tv"), *(total([c for p in every for c in [p] * p.count(b)]).alias(f"n{b}") for b in "ACGT"),
    )


def tn93(counts: DataFrame) -> DataFrame:
    """Tamura-Nei 1993 distance from pair counts, base frequencies pooled over the pair.

    0 for pairs without a difference; null where a logarithm has no value or a base is missing.
    """
    n = F.nullif(F.col("sites").cast("double"), F.lit(0.0))
    x = counts.select(
        "msp_name", "sample1", "sample2", "sites", (F.col("ag") / n).alias("p1"), (F.col("ct") / n).alias("p2"), (F.col("tv") / n).alias("q"),
        *((F.col(f"n{c}") / (2 * n)).alias(f"f{c}") for c in "ACGT"),
    ).withColumn("fR", F.col("fA") + F.col("fG")).withColumn("fY", F.col("fC") + F.col("fT"))
    c = F.col
    div = lambda a, b: a / F.nullif(b, F.lit(0.0))
    k1, k2 = div(2 * c("fA") * c("fG"), c("fR")), div(2 * c("fC") * c("fT"), c("fY"))
    k3 = 2 * (c("fR") * c("fY") - div(c("fA") * c("fG") * c("fY"), c("fR")) - div(c("fC") * c("fT") * c("fR"), c("fY")))
    x = x.withColumn("k1", k1).withColumn("k2", k2).withColumn("k3", k3)
    w1 = 1 - div(c("p1"), c("k1")) - div(c("q"), 2 * c("fR"))
    w2 = 1 - div(c("p2"), c("k2")) - div(c("q"), 2 * c("fY"))
    w3 = 1 - div(c("q"), 2 * c("fR") * c("fY"))
    x = x.withColumn("w1", w1).withColumn("w2", w2).withColumn("w3", w3)
    log = lambda w: F.ln(F.when(c(w) > 0, c(w)))
    d = -c("k1") * log("w1") - c("k2") * log("w2") - c("k3") * log("w3")
    same = (c("p1") + c("p2") + c("q")) == 0
    return x.select("msp_name", "sample1", "sample2", F.when(same, F.lit(0.0)).when(d.isNotNull(), F.greatest(d, F.lit(0.0))).alias("distance"))


def tn93_distances(seqs: DataFrame) -> DataFrame:
    return tn93(pair_counts(sequence_pairs(seqs)))


def gtr_distances(seqs: DataFrame) -> DataFrame:
    """General time-reversible distances ``d = -tr(P log(P^-1 F))``, with F the symmetric matrix of pair shares and P its
    margins; null where F has no real logarithm.

    For two sequences the model is saturated (nine free values, as many as F has), so this is the maximum of the
    likelihood where it lies inside the model.  Pair counts are built-in expressions; only 4 x 4 matrices reach Python.
    """
    cells = [x + y for x in "ACGT" for y in "ACGT"]

    @F.pandas_udf("double")
    def distance(counts):
        import numpy as np
        import pandas as pd

        f = np.array(counts.tolist(), float).reshape(-1, 4, 4)
        f = (f + f.transpose(0, 2, 1)) / 2
        total = f.sum((1, 2))
        p = f.sum(2) / np.where(total, total, 1)[:, None]
        same = (total > 0) & (np.trace(f, axis1=1, axis2=2) == total)
        out = np.where(same, 0.0, np.nan)
        full = np.flatnonzero((p > 0).all(1))
        if len(full):
            half = 1 / np.sqrt(p[full])
            value, vector = np.linalg.eigh(half[:, :, None] * f[full] / total[full, None, None] * half[:, None])
            log = np.einsum("nij,nj,nij->ni", vector, np.log(np.maximum(value, 1e-300)), vector)
            d = np.maximum(0.0, -(p[full] * log).sum(1))
            out[full] = np.where((value > 0).all(1), d, np.nan)
        return pd.Series([None if v != v else float(v) for v in out], dtype=object)

    pairs = pair_cells(sequence_pairs(seqs)).withColumn("_c", F.array(*(F.col(c).cast("double") for c in cells)))
    return pairs.select("msp_name", "sample1", "sample2", distance("_c").alias("distance"))


def upgma(names: list[str], matrix) -> list[tuple[str, str, float, int]]:
    """Merges ``(left, right, height, size)`` of average linkage; ties go to the first pair in name order."""
    import numpy as np

    d = np.array(matrix, float)
    np.fill_diagonal(d, np.inf)
    label, size, merges = list(names), [1] * len(names), []
    while len(label) > 1:
        i, j = divmod(int(np.argmin(d)), len(label))
        i, j = min(i, j), max(i, j)
        height = d[i, j] / 2
        merges.append((label[i], label[j], float(height), size[i] + size[j]))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        label[i], size[i] = f"({label[i]},{label[j]})", size[i] + size[j]
        d = np.delete(np.delete(d, j, 0), j, 1)
        del label[j], size[j]
    return merges


def _square(pdf):
    import numpy as np

    names = sorted(set(pdf["sample1"]) | set(pdf["sample2"]))
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    known = pdf["distance"].max()
    m[:] = 0.0 if np.isnan(known) else known  # a missing distance counts as the largest
    for a, b, v in zip(pdf["sample1"], pdf["sample2"], pdf["distance"]):
        if v == v and v is not None:
            m[at[a], at[b]] = m[at[b], at[a]] = v
    np.fill_diagonal(m, 0)
    return names, m


def cluster(distances: DataFrame) -> DataFrame:
    """``msp_name, step, left, right, height, size`` of UPGMA; one species' samples are one group."""

    def run(pdf):
        import pandas as pd

        names, m = _square(pdf)
        rows = [(pdf["msp_name"].iloc[0], k, *x) for k, x in enumerate(upgma(names, m))]
        return pd.DataFrame(rows, columns=["msp_name", "step", "left", "right", "height", "size"])

    return distances.groupBy("msp_name").applyInPandas(run, "msp_name string, step int, left string, right string, height double, size int")


def trees(distances: DataFrame) -> DataFrame:
    """``msp_name, newick`` with branch lengths."""

    def run(pdf):
        import pandas as pd

        names, m = _square(pdf)
        text, height = {n: n for n in names}, dict.fromkeys(names, 0.0)
        key = ""
        for a, b, h, _ in upgma(names, m):
            key = f"({a},{b})"
            text[key] = f"({text[a]}:{h - height[a]:.10g},{text[b]}:{h - height[b]:.10g})"
            height[key] = h
        return pd.DataFrame([(pdf["msp_name"].iloc[0], (text[key] if key else names[0]) + ";")], columns=["msp_name", "newick"])

    return distances.groupBy("msp_name").applyInPandas(run, "msp_name string, newick string")


def cophenetic(distances: DataFrame) -> DataFrame:
    """Tip-to-tip distances on the UPGMA tree: ``msp_name, sample1, sample2, distance``."""

    def run(pdf):
        import pandas as pd

        names, m = _square(pdf)
        tips = {n: [n] for n in names}
        rows = []
        for a, b, h, _ in upgma(names, m):
            rows += [(pdf["msp_name"].iloc[0], min(x, y), max(x, y), 2 * h) for x in tips[a] for y in tips[b]]
            tips[f"({a},{b})"] = tips[a] + tips[b]
        return pd.DataFrame(rows, columns=["msp_name", "sample1", "sample2", "distance"])

    return distances.groupBy("msp_name").applyInPandas(run, "msp_name string, sample1 string, sample2 string, distance double")
