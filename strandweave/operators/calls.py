"""From breakpoints to variants: filter and vote, classification, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.columns import INVERTED, LARGE, NOT_DECIDED, SWAPPED, breakend_alt
from strandweave.operators.intervals import bin_join, in_order
from strandweave.options import CallOptions
from strandweave.session import settled


def voted(bps: DataFrame, o: CallOptions, depth_threshold: Column | float) -> DataFrame:
    """``bps`` with score, vt (votes) and filtered.

    A breakpoint passes by the sum of its evidence, or, unless one vote is
    enough, by the number of kinds of evidence that vote for it. An inversion
    leaves depth as it is, so votes rescue one only if depth is asked for.
    """
    limit = depth_threshold if isinstance(depth_threshold, Column) else F.lit(depth_threshold)
    votes = (F.col("se") + F.col("ce") >= o.min_split_support).cast("int")
    if o.use_pairs:
        votes = votes + (F.col("pe") >= o.min_pair_support).cast("int")
    if o.use_depth:
        votes = votes + (F.coalesce(F.col("re"), F.lit(0.0)) >= limit).cast("int")
    score = F.col("se") + F.col("pe") + F.col("ce")
    may = F.lit(o.votes_needed != 1) & (F.lit(o.depth_for_balanced) | (F.col("orientation") != INVERTED))
    passed = (score >= o.cutoff) | (may & (votes >= o.votes_needed))
    return bps.withColumns({"score": score, "vt": votes, "filtered": ~passed})


_CARRIED = ("se", "pe", "ce", "re", "rd", "vt", "imprecise")


def _variants(bps: DataFrame, kind: str, status: Column) -> DataFrame:
    size = F.col("final_right") - F.col("final_left") + 1
    return bps.select("bp_id", F.lit(kind).alias("sv_type"), "template_id", F.col("final_left").alias("begin_pos"), F.col("final_right").alias("end_pos"), F.lit(None).cast("long").alias("target_pos"), size.alias("size"), status.alias("status"), *_CARRIED)


def inversions(bps: DataFrame, o: CallOptions) -> DataFrame:
    found = bps.where((F.col("orientation") == INVERTED) & ~F.col("filtered") & (F.col("final_left") < F.col("final_right")))
    return _variants(found, "INV", F.lit("PASS")).where(F.col("size") >= o.min_sv_size).drop("size")


def deletions(bps: DataFrame, o: CallOptions, depth_threshold: float | None = None) -> DataFrame:
    """Filtered ones stay, marked; an imprecise one without a drop in depth is marked too."""
    found = bps.where((F.col("orientation") == LARGE) & (F.col("final_left") < F.col("final_right")))
    bad = F.col("filtered")
    if depth_threshold is not None:
        bad = bad | (F.col("imprecise") & (F.coalesce(F.col("rd"), F.lit(0.0)) > depth_threshold))
    return _variants(found, "DEL", F.when(bad, "FILTERED").otherwise("PASS")).where(F.col("size") >= o.min_sv_size).drop("size")


def _middle(exact: Column, rough: Column) -> Column:
    """Upper median of the exact positions, or of the rough ones if there are none."""
    own = lambda a: F.get(F.sort_array(a), F.floor(F.size(a) / 2).cast("int"))
    return F.when(F.size(exact) > 0, own(exact)).otherwise(own(rough))


def duplications(bps: DataFrame, dels: DataFrame, o: CallOptions) -> tuple[DataFrame, DataFrame]:
    """(duplications, deletions with those that duplications have taken in marked MERGED).

    A deletion near one end of a duplication shows where the copy went: with
    none it is a tandem; with one side it is inserted at the other; with
    deletions on both sides it is a translocation and stays as a merged
    duplication.
    """
    tol = o.adj_tol
    bps, dels = settled(bps), settled(dels)
    dup = bps.where((F.col("orientation") == SWAPPED) & ~F.col("filtered")).select(F.col("bp_id").alias("dup_id"), "template_id", F.col("final_left").alias("left_pos"), F.col("final_right").alias("right_pos"), *_CARRIED)
    near = dels.select(F.col("bp_id").alias("del_id"), "template_id", F.col("begin_pos").alias("db"), F.col("end_pos").alias("de"), F.col("imprecise").alias("rough"))
    around = dup.select("dup_id", "template_id", (F.col("left_pos") - tol).alias("l1"), (F.col("left_pos") + tol).alias("l2"), (F.col("right_pos") - tol).alias("r1"), (F.col("right_pos") + tol).alias("r2"))
    at_left = bin_join(around, near, ["template_id"], ("l1", "l2"), ("db", "db")).withColumn("side", F.lit(1))
    at_right = bin_join(around, near, ["template_id"], ("r1", "r2"), ("de", "de")).withColumn("side", F.lit(2))
    hits = settled(at_left.unionByName(at_right).groupBy("dup_id", "del_id", "db", "de", "rough").agg(F.sum("side").alias("sides")))

    def kept(cond: Column, pos: str) -> Column:
        return F.collect_list(F.when(cond, F.col(pos)))

    sides, rough = F.col("sides"), F.col("rough")
    seen = hits.groupBy("dup_id").agg(
        kept((sides != 2) & ~rough, "db").alias("le"), kept((sides != 2) & rough, "db").alias("lr"),
        kept((sides != 1) & ~rough, "de").alias("re_"), kept((sides != 1) & rough, "de").alias("rr"),
        kept((sides == 2) & ~rough, "db").alias("ce_"),
        F.concat(kept((sides == 2) & rough, "db"), kept(sides == 1, "de")).alias("cr"),
        F.max(sides == 1).alias("only_left"), F.max(sides == 2).alias("only_right"),
    )
    rows = dup.join(seen, "dup_id", "left")
    empty = F.array().cast("array<bigint>")
    arr = {x: F.coalesce(F.col(x), empty) for x in ("le", "lr", "re_", "rr", "ce_", "cr")}
    own = lambda pos, is_rough: F.when(F.col("imprecise") == is_rough, F.array(pos)).otherwise(empty)
    left_e, left_r = F.concat(arr["le"], own("left_pos", False)), F.concat(arr["lr"], own("left_pos", True))
    right_e, right_r = F.concat(arr["re_"], own("right_pos", False)), F.concat(arr["rr"], own("right_pos", True))
    rows = rows.select(
        "dup_id", "template_id", *[x for x in _CARRIED if x != "imprecise"],
        _middle(left_e, left_r).alias("l"), _middle(right_e, right_r).alias("r"),
        F.when(F.size(arr["ce_"]) + F.size(arr["cr"]) > 0, _middle(arr["ce_"], arr["cr"])).alias("m"),
        (F.col("imprecise") | (F.size(left_e) == 0) | (F.size(right_e) == 0) | ((F.size(arr["ce_"]) == 0) & (F.size(arr["cr"]) > 0))).alias("imprecise"),
        F.coalesce("only_left", F.lit(False)).alias("ol"), F.coalesce("only_right", F.lit(False)).alias("orr"),
    )
    le, ri, mi = F.col("l"), F.col("r"), F.col("m")

    def variant(kind: str, begin: Column, end: Column, target: Column, status: str = "PASS") -> Column:
        return F.struct(F.lit(kind).alias("sv_type"), begin.alias("begin_pos"), end.alias("end_pos"), target.cast("long").alias("target_pos"), F.lit(status).alias("status"))

    both = F.array(variant("TRA", le, mi, ri), variant("DUP", le, mi, ri, "MERGED"))
    each = F.when(mi.isNull(), F.array(variant("DUP:TANDEM", le, ri, F.lit(None)))).when(F.col("ol") & F.col("orr"), both).when(F.col("ol"), F.array(variant("DUP", mi, ri, le))).otherwise(F.array(variant("DUP", le, mi, ri)))
    calls = rows.withColumn("v", F.explode(each)).select(F.col("dup_id").alias("bp_id"), "v.*", "template_id", *_CARRIED)
    large = (F.col("begin_pos") <= F.col("end_pos")) & (F.col("end_pos") - F.col("begin_pos") + 1 >= o.min_sv_size)
    calls = calls.where(large | (F.col("sv_type") == "TRA") | (F.col("status") == "MERGED"))
    taken = hits.select(F.col("del_id").alias("bp_id")).distinct().withColumn("taken", F.lit(True))
    left = dels.join(taken, "bp_id", "left").withColumn("status", F.when(F.col("taken"), "MERGED").otherwise(F.col("status"))).drop("taken")
    return calls, left


def translocations(calls: DataFrame, o: CallOptions) -> DataFrame:
    """``calls`` of duplications and the translocations that pairs of them make up.

    Of two duplications of which each is inserted where the other lies, a
    translocation is made with the evidence of both. A passing translocation
    takes in the duplications that lie within it; the first in genome order wins.
    """
    tol = o.adj_tol
    order = ["template_id", "begin_pos", "end_pos", "bp_id"]
    calls = settled(calls)
    many = calls.count()
    dups = settled(in_order(calls.where(F.col("sv_type").startswith("DUP")), order, "ord", many))
    i = dups.where("target_pos is not null").select([F.col(x).alias(f"i_{x}") for x in dups.columns if x != "template_id"] + ["template_id", (F.col("begin_pos") - tol).alias("lo"), (F.col("begin_pos") + tol).alias("hi")])
    j = dups.where("target_pos is not null").select([F.col(x).alias(f"j_{x}") for x in dups.columns if x != "template_id"] + ["template_id"])
    pair = settled(bin_join(i, j, ["template_id"], ("lo", "hi"), ("j_target_pos", "j_target_pos"), (F.col("i_ord") < F.col("j_ord")) & (F.abs(F.col("j_end_pos") - F.col("i_target_pos")) <= tol)))
    made = pair.select(
        F.col("i_bp_id").alias("bp_id"), F.lit("TRA").alias("sv_type"), F.col("i_begin_pos").alias("begin_pos"), F.col("i_end_pos").alias("end_pos"), F.col("i_target_pos").alias("target_pos"),
        F.when((F.col("i_status") == "PASS") | (F.col("j_status") == "PASS"), "PASS").otherwise(F.col("i_status")).alias("status"), "template_id",
        *[(F.col(f"i_{x}") + F.col(f"j_{x}")).alias(x) for x in ("se", "pe", "ce")],
        F.greatest("i_re", "j_re").alias("re"), F.col("i_rd").alias("rd"), F.greatest("i_vt", "j_vt").alias("vt"), F.col("i_imprecise").alias("imprecise"),
    )
    merged = pair.select(F.explode(F.array("i_ord", "j_ord")).alias("ord")).distinct().withColumn("gone", F.lit(True))
    dups = dups.join(merged, "ord", "left").withColumn("status", F.when(F.col("gone"), "MERGED").otherwise(F.col("status"))).drop("gone")
    tra = settled(in_order(calls.where("sv_type = 'TRA'").unionByName(made.select(calls.columns)), order, "tra", many + pair.count()))
    span = tra.where("status = 'PASS' and begin_pos <= end_pos").select("tra", "template_id", F.col("begin_pos").alias("tb"), F.col("end_pos").alias("te"))
    inner = dups.where("status <> 'MERGED' and begin_pos <= end_pos").select("ord", "template_id", F.col("begin_pos").alias("db"), F.col("end_pos").alias("de"), "se", "pe", "ce")
    held = settled(bin_join(span, inner, ["template_id"], ("tb", "te"), ("db", "de")).groupBy("ord").agg(F.min("tra").alias("tra"), *[F.first(x).alias(x) for x in ("se", "pe", "ce")]))
    gain = held.groupBy("tra").agg(*[F.sum(x).alias(f"more_{x}") for x in ("se", "pe", "ce")])
    tra = tra.join(gain, "tra", "left").withColumns({x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0)) for x in ("se", "pe", "ce")})
    absorbed = held.select("ord").withColumn("gone", F.lit(True))
    dups = dups.join(absorbed, "ord", "left").withColumn("status", F.when(F.col("gone"), "MERGED").otherwise(F.col("status")))
    return dups.select(calls.columns).unionByName(tra.select(calls.columns))


def breakends(bps: DataFrame, contigs: DataFrame, left_template: str = "template_id", right_template: str = "right_template") -> DataFrame:
    """Two records for each undecided breakpoint, told by ``no``, each pointing at the other; ``contigs(template_id, name)``."""
    found = bps.where((F.col("orientation") == NOT_DECIDED) & ~F.col("filtered")).withColumns({"__lt": F.col(left_template), "__rt": F.col(right_template)})
    names = contigs.select("template_id", "name")
    rows = found.join(names.select(F.col("template_id").alias(left_template), F.col("name").alias("ln")), left_template)
    rows = rows.join(names.select(F.col("template_id").alias(right_template), F.col("name").alias("rn")), right_template)
    same = F.col("left_reverse") == F.col("right_reverse")
    one = F.struct(F.lit(1).alias("no"), F.col("__lt").alias("template_id"), F.col("ln").alias("chrom"), F.col("final_left").alias("begin_pos"), breakend_alt(same, F.col("rn"), F.col("final_right"), True).alias("alt"))
    two = F.struct(F.lit(2).alias("no"), F.col("__rt").alias("template_id"), F.col("rn").alias("chrom"), F.col("final_right").alias("begin_pos"), breakend_alt(same, F.col("ln"), F.col("final_left"), False).alias("alt"))
    rest = [x for x in _CARRIED if x in bps.columns]
    return rows.select("bp_id", F.explode(F.array(one, two)).alias("v"), *rest).select("bp_id", "v.*", *rest)


def ranked(calls: DataFrame, id_col: str = "bp_id") -> DataFrame:
    """``calls`` with sc: how a passing variant ranks by the median of its ranks by each kind of evidence, 0 to 100.

    Ties go by depth, then by id. Unknown evidence counts as none, as in votes.
    """
    calls = settled(calls)
    rows = calls.where("status = 'PASS'")
    total = rows.count()
    for name, value in (("__a", F.col("se") + F.col("ce")), ("__b", F.col("pe")), ("__c", F.coalesce("re", F.lit(0.0)))):
        rows = in_order(rows, [-value, F.coalesce("rd", F.lit(0.0)), id_col], name, total)
    rows = in_order(rows.withColumn("__m", F.get(F.sort_array(F.array("__a", "__b", "__c")), F.lit(1))), ["__m", id_col], "__o", total)
    # a median's rank is the first place that it takes; places of three orders repeat a median three times at most
    rows = settled(rows)
    first = rows.groupBy("__m").agg(F.min("__o").alias("__r"))
    score = F.lit(100.0) if total == 1 else (1 - (F.col("__r") - 1) / (total - 1)) * 100
    rows = rows.join(first, "__m").withColumn("sc", score).drop("__a", "__b", "__c", "__m", "__r", "__o")
    return rows.unionByName(calls.where("status <> 'PASS'").withColumn("sc", F.lit(-1.0)))


def by_evidence(calls: DataFrame) -> DataFrame:
    """``calls`` with sc: the sum of the evidence."""
    return calls.withColumn("sc", (F.col("se") + F.col("pe") + F.col("ce")).cast("double"))


def numbered(calls: DataFrame, id_col: str = "bp_id") -> DataFrame:
    """``calls`` with sv_id, numbered per type in genome order: from 0 for translocations, from 1 else.

    Tandem duplications count among duplications. The two records of a
    breakend, told by the column ``no``, share a number and add their own.
    """
    twin = "no" in calls.columns
    rows = settled(calls.withColumn("__k", F.regexp_replace("sv_type", ":.*", "")))
    heads = in_order(rows.where("no is null or no = 1") if twin else rows, ["__k", "template_id", "begin_pos", "end_pos", id_col, "sv_type", "status"], "__n", rows.count())
    first = heads.groupBy("__k").agg(F.min("__n").alias("__first"))
    number = F.col("__n") - F.col("__first") + F.when(F.col("__k") == "TRA", 0).otherwise(1)
    heads = heads.join(F.broadcast(first), "__k").withColumn("__n", number).drop("__first")
    if twin:
        seconds = rows.where("no = 2").join(heads.where("no = 1").select(id_col, "__n"), id_col)
        heads = heads.unionByName(seconds)
    text = F.concat_ws("_", "__k", F.col("__n").cast("string"), *([F.col("no").cast("string")] if twin else []))
    return heads.withColumn("sv_id", text).select(*calls.columns, "sv_id")
