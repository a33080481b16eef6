"""Matching entities across tables that share no key, with a confidence for each match.

1. Records are reduced to classes of equal form, kind and senses; glosses become sets of sense tokens, kept as hashes.
2. Which tokens mean the same is learnt without labels: two tokens are synonyms if they stand in two renderings of one
   record, or in records of one base in two tables, far more often than chance allows. The latter are counted from the
   tokens of each base and table, as products of counts; a base weighs no more than its smaller side has records.
3. Candidates share a form and a sense, or a form where one side names no sense, or have forms one edit apart (hashed
   deletion keys) and share a sense, or both match a third record. Forms with many pairs are joined by form *and* sense
   token, so a form of a third of all rows gives pairs of like sense only; both ways give the same candidates. Pairs that
   share or nearly share a form and no sense are never made: how many there are of each similarity follows from products
   of counts, and they take part in the fit as that many vectors.
4. A regularised two-component Gaussian mixture is fitted to the similarity vectors (form, senses, kind; missing ones are
   integrated out). Vectors are rounded, so the fit works on the counts of at most a few hundred distinct vectors, exactly
   as on all pairs. Each E-step is followed by the transitivity constraint on the triangles of pairs, over all three
   tables: with ``p(xy) p(yz) > p(xz)`` the third posterior is raised if its senses don't speak against it, else the
   weaker of the other two is lowered; the M-step takes what results, until nothing moves.

The form similarity is measured: the mean of that of the two forms that met and that of the two bases, each one less the
edits over the longer length.

Defined results: records without a form match nothing; without senses they match by form and kind
alone, with the confidence the mixture gives that; rows with equal ids count as members of each class
they fall into, pairs come out once; an empty table matches nothing; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.plain_text import plain_column
from lexiforge.operators import nested_records as nested
from lexiforge.runtime import cut, written

#: Forms that give more pairs of records than this are joined by form and sense. That changes the plan, not the candidates.
HOT = 4096
#: Forms one edit apart are compared if they are at least so much alike, that is, from three letters on.
ALIKE = 2 / 3
#: A posterior that moves less than this is settled; the fit ends then, or after so many rounds.
SETTLED, MOST_ROUNDS = 1e-4, 100

_NOISE = r"\([^()]*\)|（[^（）]*）|\bcf\. *[^\s,;/|、]+|\bsense +\d+|[\"“”„«»「」『』]|表示|的"
_SPLIT = r"\s*[,;/|、，；／｜•\n\t]+\s*|\s+or\s+"
_QUALIFIER = r"(?<=\S)\s+(?:of|in|by|at|with|for|as)\s+\S.*$|\s+loosely$"


def norm_form(text: Column) -> Column:
    """Letters only, without case: dashes, blanks and marks around or inside a form don't count."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


def sense_tokens(plain: Column) -> Column:
    """The senses of a gloss in plain form, as a sorted set of hashes; each ideograph is a sense of its own."""
    bare = F.regexp_replace(F.lower(plain), r"so-called\s+\"*([^\"]*?)\"*\s+sense", "$1")
    items = F.split(F.regexp_replace(bare, _NOISE, " "), _SPLIT)
    parts = F.flatten(F.transform(items, lambda i: F.concat(F.regexp_extract_all(i, F.lit(r"\p{IsHan}"), F.lit(0)), F.array(F.regexp_replace(i, r"\p{IsHan}", " ")))))
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), "^to ", ""), _QUALIFIER, "")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(clean, lambda p: p.rlike(r"\p{L}")), lambda p: F.xxhash64(p))))


def _kind(declared: Column | None, dashed: Column) -> Column:
    """prefix, suffix or root, as declared or as the dashes say; null if neither says."""
    d = F.regexp_replace(F.trim(dashed), r"\p{Pd}", "-")
    shown = F.when(d.rlike("^-.*-$"), "root").when(d.startswith("-"), "suffix").when(d.endswith("-"), "prefix")
    if declared is None:
        return shown
    said = F.lower(F.trim(declared))
    return F.coalesce(F.when(said.isin("prefix", "suffix", "root"), said), shown)


def affix_records(df: DataFrame, tbl: str, id_col: str, form_col: str, gloss_col: str, kind: Column | None = None) -> DataFrame:
    rows = df.select(F.lit(tbl).alias("tbl"), F.col(id_col).alias("id"), F.col(form_col).alias("_f"), F.col(gloss_col).alias("_g"), _kind(kind, F.col(form_col)).alias("kind"))
    rows = plain_column(plain_column(rows, "_g", "_pg"), "_f", "_pf")
    tokens = F.coalesce(sense_tokens(F.col("_pg")), F.array().cast("array<bigint>"))
    none = F.array().cast("array<bigint>")
    rows = rows.select("tbl", "id", norm_form(F.col("_pf")).alias("base"), "kind", tokens.alias("t1"), none.alias("t2"))
    return rows.withColumn("forms", F.array("base")).where("base != ''")


def root_records(roots: DataFrame) -> DataFrame:
    """Root entries with all forms they nest; ``t1`` the senses of the meaning, ``t2`` those of the etymology."""
    found = nested.nodes(roots.select("entry_id", "forms"), "entry_id", "forms").where("kind = 'form'")
    derived = found.groupBy("entry_id").agg(F.collect_set(norm_form(F.col("name"))).alias("derived"))
    rows = plain_column(plain_column(roots.select(F.col("entry_id").alias("id"), "base", "meaning", "ety_meaning"), "meaning", "_p1"), "ety_meaning", "_p2")
    none = F.array().cast("array<bigint>")
    rows = rows.join(derived.withColumnRenamed("entry_id", "id"), "id", "left")
    base = norm_form(F.col("base"))
    forms = F.array_sort(F.filter(F.array_distinct(F.concat(F.array(base), F.coalesce("derived", F.array().cast("array<string>")))), lambda f: f != ""))
    return rows.select(
        F.lit("a").alias("tbl"), "id", F.coalesce(base, F.lit("")).alias("base"), F.lit(None).cast("string").alias("kind"),
        F.coalesce(sense_tokens(F.col("_p1")), none).alias("t1"), F.coalesce(sense_tokens(F.col("_p2")), none).alias("t2"), forms.alias("forms"),
    ).where(F.size("forms") > 0)


PARTS = ["tbl", "base", "kind", "t1", "t2", "forms"]


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cls, tbl, base, kind, t1, t2, forms`` and ``cls, id``: equal records as one, with their members. ``cls`` is a hash of 128 bits."""
    keyed = written(records.withColumn("cls", F.struct(F.xxhash64(F.lit(1), *PARTS).alias("x"), F.xxhash64(F.lit(2), *PARTS).alias("y"))))
    return keyed.groupBy("cls").agg(*[F.first(p).alias(p) for p in PARTS]), keyed.select("cls", "id").distinct()


def learn_synonyms(cls: DataFrame) -> DataFrame:
    """``u, v``: tokens that mean the same, each also with itself; symmetric."""
    both_ways = lambda df: df.unionByName(df.select(F.col("y").alias("x"), F.col("x").alias("y")))
    two = both_ways(cls.where((F.size("t1") > 0) & (F.size("t2") > 0)).select(F.col("t1").alias("x"), F.col("t2").alias("y")))
    told = cls.select("tbl", "base", F.array_union("t1", "t2").alias("t")).where((F.size("t") > 0) & (F.col("base") != ""))
    tokens = cut(told.select("tbl", "base", F.explode("t").alias("u")).groupBy("tbl", "base", "u").agg(F.count("*").alias("c")))
    sizes = told.groupBy("tbl", "base").agg(F.count("*").alias("k"))
    sides = sizes.join(sizes.toDF("tbl2", "base", "k2"), "base").where("tbl != tbl2")
    sides = cut(sides.withColumn("w", 1.0 / F.greatest("k", "k2")))  # at most six rows a base
    left = tokens.join(sides, ["tbl", "base"])
    one = left.groupBy("u").agg(F.sum(F.col("c") * F.col("k2") * F.col("w")).alias("n"))
    pairs = left.select("base", F.col("tbl2").alias("tbl"), "u", (F.col("c") * F.col("w")).alias("cw")).join(tokens.toDF("tbl", "base", "v", "c2"), ["tbl", "base"])
    pairs = pairs.groupBy("u", "v").agg(F.sum(F.col("cw") * F.col("c2")).alias("n"))
    singles = two.select(F.explode("x").alias("u")).groupBy("u").agg(F.count("*").cast("double").alias("n")).unionByName(one).groupBy("u").agg(F.sum("n").alias("nu"))
    seen = two.select(F.explode("x").alias("u"), "y").select("u", F.explode("y").alias("v")).groupBy("u", "v").agg(F.count("*").cast("double").alias("n"))
    seen = seen.unionByName(pairs).where("u != v").groupBy("u", "v").agg(F.sum("n").alias("nuv"))
    n = two.count() + (sides.agg(F.sum(F.col("k") * F.col("k2") * F.col("w"))).first()[0] or 0)
    rated = seen.where("nuv >= 3").join(singles, "u").join(singles.toDF("v", "nv"), "v")
    chance = F.col("nu") * F.col("nv") / F.lit(float(max(1, n)))
    real = rated.where((F.col("nuv") >= 3 + chance + 5 * F.sqrt(chance)) & (F.col("nuv") >= 8 * chance) & (F.col("nuv") >= 0.04 * F.least("nu", "nv")))
    each = cls.select(F.explode(F.concat("t1", "t2")).alias("u")).distinct()
    return cut(real.select("u", "v").unionByName(each.select("u", F.col("u").alias("v"))).distinct())


def _expanded(cls: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Classes with the tokens that mean the same as one of ``t1`` and ``t2``: ``e1``, ``e2``."""
    means = synonyms.groupBy("u").agg(F.collect_list("v").alias("e"))
    mark = lambda t, i: F.transform(t, lambda u: F.struct(F.lit(i).alias("i"), u.alias("u")))
    each = cls.select("cls", F.explode(F.concat(mark("t1", 1), mark("t2", 2))).alias("x")).select("cls", "x.i", "x.u").join(means, "u")
    of = lambda i: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("i") == i, F.col("e"))))).alias(f"e{i}")
    none = F.array().cast("array<bigint>")
    out = cls.join(each.groupBy("cls").agg(of(1), of(2)), "cls", "left")
    return written(out.withColumns({"e1": F.coalesce("e1", none), "e2": F.coalesce("e2", none)}))


def _alike(a: Column, b: Column) -> Column:
    """One less the edits over the longer length; 0 for empty forms."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(0.0)


def near_forms(forms: DataFrame) -> DataFrame:
    """``form, other, s``: distinct forms (``fid, form, mask``) one insertion, deletion, substitution or swap apart, in both directions, that can give pairs of two tables.

    ``mask`` has a bit for each table that knows the form. Only numbers and hashes of deletions are joined, with a form of a table
    other than the first on one side; forms are fetched for what is left.
    """
    least = round(1 / (1 - ALIKE))
    form = F.col("form")
    gone = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.xxhash64(F.concat(F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, F.length(form)))))
    keyed = forms.where(F.length(form) >= least).select("fid", "mask", F.explode(F.array_distinct(F.concat(F.array(F.xxhash64(form)), gone))).alias("key"))
    others = keyed.where(F.col("mask").bitwiseAND(~1) != 0).toDF("fid2", "mask2", "key")
    pairs = others.join(keyed, "key").where((F.col("fid") != F.col("fid2")) & (F.bit_count(F.col("mask").bitwiseOR(F.col("mask2"))) > 1)).select("fid", "fid2").distinct()
    named = pairs.join(forms.select("fid", "form"), "fid").join(forms.select(F.col("fid").alias("fid2"), F.col("form").alias("other")), "fid2")
    d = F.levenshtein("form", "other")
    swapped = (d == 2) & (F.length("form") == F.length("other")) & (F.array_sort(F.split("form", "")) == F.array_sort(F.split("other", "")))
    found = named.where((d == 1) | swapped).select("form", "other")
    both = found.unionByName(found.select(F.col("other").alias("form"), F.col("form").alias("other"))).distinct()
    return both.select("form", "other", (1 - 1 / F.greatest(F.length("form"), F.length("other"))).alias("s"))


def _overlap(ta: str, ea: str, tb: str, eb: str) -> Column:
    """Share of the senses on either side that the other side has; null where a side has none."""
    hits = F.size(F.array_intersect(F.col(ta), F.col(eb))) + F.size(F.array_intersect(F.col(tb), F.col(ea)))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), hits / (F.size(ta) + F.size(tb)))


WIDE = ["cls", "tbl", "base", "kind", "t1", "t2", "e1", "e2"]


def _sided(df: DataFrame, side: str, *more: str | Column) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in WIDE], *more)


def _form_sim() -> Column:
    return F.round((F.col("s") + _alike(F.col("base_a"), F.col("base_b"))) / 2, 1)


def _kind_sim() -> Column:
    return F.when(F.col("kind_a").isNotNull() & F.col("kind_b").isNotNull(), (F.col("kind_a") == F.col("kind_b")).cast("double"))


def compared(pairs: DataFrame) -> DataFrame:
    """``ca, cb, ta, tb, fs, gs, ks, s`` of pairs with all columns of both sides and the similarity ``s`` of the forms that met."""
    best = F.greatest(*[_overlap(f"t{i}_a", f"e{i}_a", f"t{j}_b", f"e{j}_b") for i in (1, 2) for j in (1, 2)])
    return pairs.select(F.col("cls_a").alias("ca"), F.col("cls_b").alias("cb"), F.col("tbl_a").alias("ta"), F.col("tbl_b").alias("tb"), _form_sim().alias("fs"), F.round(best, 1).alias("gs"), _kind_sim().alias("ks"), "s")


def _worth(rows: DataFrame) -> DataFrame:
    """A form with itself needs a sense in common or none on a side, near ones need one in common."""
    return rows.where("gs > 0 or (gs is null and s = 1.0)")


def candidates(full: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The pairs worth comparing (``ca, cb, ta, tb, fs, gs, ks``; ``ca`` of the lesser table), and ``fs, ks, n``: how many pairs share or nearly share a form, but no sense."""
    keys = full.select(*WIDE, F.explode("forms").alias("form"))
    tables = keys.groupBy("form", "tbl").agg(F.count("*").alias("n")).groupBy("form").agg(F.collect_set("tbl").alias("tables"), F.map_from_entries(F.collect_list(F.struct("tbl", "n"))).alias("by"))
    bits = F.aggregate("tables", F.lit(0), lambda m, t: m.bitwiseOR(F.when(t == "a", 1).when(t == "b", 2).otherwise(4)))
    tables = cut(tables.withColumns({"fid": F.monotonically_increasing_id(), "mask": bits}))
    near = near_forms(tables.select("fid", "form", "mask"))
    met = tables.where(F.size("tables") > 1).select("form", F.col("form").alias("other"), F.lit(1.0).alias("s")).unionByName(near)
    # a form with itself once, with others in both directions, as the lesser table is on the left
    size = lambda f, t: F.coalesce(F.col(f)[t], F.lit(0))
    work = size("by", "a") * size("by2", "b") + size("by", "a") * size("by2", "c") + size("by", "b") * size("by2", "c")
    met = met.join(tables.select("form", "by"), "form").join(tables.select(F.col("form").alias("other"), F.col("by").alias("by2")), "other")
    met = written(met.select("form", "other", "s", work.alias("work")).where("work > 0"))
    cool, busy = met.where(F.col("work") <= hot).drop("work"), met.where(F.col("work") > hot).drop("work")

    def sides(links: DataFrame, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(links, "form").join(right, on).where("tbl_a < tbl_b")

    plain = _worth(compared(sides(cool, _sided(keys, "a", "form"), _sided(keys, "b", F.col("form").alias("other")), ["other"])))
    # by form and sense: one side under its tokens, the other under all that mean the same as one of its own
    crowd = busy.select("form").unionByName(busy.select(F.col("other").alias("form"))).distinct()
    narrow = keys.join(crowd, "form", "left_semi").select("cls", "tbl", "form", F.array_union("t1", "t2").alias("t"), F.array_union("e1", "e2").alias("e"))
    left = lambda df, *more: df.select(F.col("cls").alias("cls_a"), F.col("tbl").alias("tbl_a"), "form", *more)
    right = lambda df, *more: df.select(F.col("cls").alias("cls_b"), F.col("tbl").alias("tbl_b"), F.col("form").alias("other"), *more)
    same, mute, loud = busy.where("s = 1.0"), narrow.where(F.size("t") == 0), narrow.where(F.size("t") > 0)
    ways = [
        sides(busy, left(loud, F.explode("t").alias("u")), right(loud, F.explode("e").alias("u")), ["other", "u"]),
        sides(same, left(narrow), right(mute), ["other"]),
        sides(same, left(mute), right(loud), ["other"]),
    ]
    ids = ["cls_a", "cls_b", "form", "other", "s"]
    few = ways[0].select(*ids).distinct().unionByName(ways[1].select(*ids)).unionByName(ways[2].select(*ids))
    crowded = _worth(compared(few.join(_sided(full, "a"), "cls_a").join(_sided(full, "b"), "cls_b")))
    found = written(plain.unionByName(crowded))
    # what was not made: all pairs of records with senses, by products of counts, less those found
    bare = keys.where((F.size("t1") > 0) | (F.size("t2") > 0)).groupBy("form", "tbl", "base", "kind").agg(F.count("*").alias("n"))
    named = lambda side, f: bare.select(F.col("form").alias(f), F.col("tbl").alias(f"tbl_{side}"), F.col("base").alias(f"base_{side}"), F.col("kind").alias(f"kind_{side}"), F.col("n").alias(f"n_{side}"))
    every = sides(met, named("a", "form"), named("b", "other"), ["other"]).select(_form_sim().alias("fs"), _kind_sim().alias("ks"), (F.col("n_a") * F.col("n_b")).alias("n"))
    made = found.where("gs is not null").select("fs", "ks", F.lit(-1).cast("bigint").alias("n"))
    unlike = every.unionByName(made).groupBy("fs", "ks").agg(F.sum("n").alias("n")).where("n > 0")
    best = found.groupBy("ca", "cb").agg(F.first("ta").alias("ta"), F.first("tb").alias("tb"), F.max("fs").alias("fs"), F.first("gs").alias("gs"), F.first("ks").alias("ks"))
    return best, unlike


class Mixture:
    """Two Gaussians with diagonal, regularised covariances over vectors with missing parts; component 1 is the matches."""

    FLOOR = 0.02

    def __init__(self, x: np.ndarray, start: np.ndarray, weight: np.ndarray):
        self.x, self.w = x, weight
        self.maximise(start)

    def maximise(self, p: np.ndarray) -> None:
        seen = ~np.isnan(self.x)
        filled = np.where(seen, self.x, 0.0)
        self.pi = min(0.99, max(0.01, float((p * self.w).sum() / max(self.w.sum(), 1e-9))))
        whole = (seen * self.w[:, None]).sum(0) + 1e-9
        overall = (filled * self.w[:, None]).sum(0) / whole
        self.mu, self.var = [], []
        for q in (1 - p, p):
            n = (seen * (q * self.w)[:, None]).sum(0)
            mu = ((filled * (q * self.w)[:, None]).sum(0) + overall) / (n + 1)  # one pseudo-pair, so that an empty side stays defined
            var = (np.where(seen, (filled - mu) ** 2, 0.0) * (q * self.w)[:, None]).sum(0) / (n + 1)
            self.mu.append(mu)
            self.var.append(var + self.FLOOR)

    def expect(self) -> np.ndarray:
        logs = []
        for mu, var, pi in zip(self.mu, self.var, (1 - self.pi, self.pi)):
            each = -0.5 * ((self.x - mu) ** 2 / var + np.log(2 * np.pi * var))
            logs.append(np.where(np.isnan(self.x), 0.0, each).sum(1) + np.log(pi))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))

    def fit(self, rounds: int = 60) -> np.ndarray:
        p = self.expect()
        for _ in range(rounds):
            self.maximise(p)
            new = self.expect()
            if np.abs(new - p).max() < 1e-6:
                return new
            p = new
        return p


def _triangles(pairs: DataFrame) -> DataFrame:
    """``i1, v1, o1`` to ``i3, v3, o3``: three pairs that join three records of three tables; ``o`` if the senses of a pair speak against it."""

    def of(x: str, y: str, n: int, a: str, b: str) -> DataFrame:
        rows = pairs.where((F.col("ta") == x) & (F.col("tb") == y))
        return rows.select(F.col("ca").alias(a), F.col("cb").alias(b), F.col("i").alias(f"i{n}"), F.col("vec").alias(f"v{n}"), F.coalesce(F.col("gs") == 0, F.lit(False)).alias(f"o{n}"))

    return of("a", "b", 1, "r", "h").join(of("a", "c", 2, "r", "q"), "r").join(of("b", "c", 3, "h", "q"), ["h", "q"]).select(*[f"{c}{n}" for n in (1, 2, 3) for c in "ivo"])


def _moved(triangles: DataFrame, p: list[float]) -> DataFrame:
    """``i, vec, p, q``: pairs of triangles with their posterior before and after the constraint."""
    known = F.array(*[F.lit(float(x)) for x in p])
    q = [F.get(known, F.col(f"v{n}")) for n in (1, 2, 3)]
    moves = []
    for z in range(3):
        x, y = (k for k in range(3) if k != z)
        broken = q[x] * q[y] > q[z]
        against, weak = F.col(f"o{z + 1}"), q[x] <= q[y]
        up = F.struct(F.col(f"i{z + 1}").alias("i"), F.col(f"v{z + 1}").alias("vec"), (q[x] * q[y]).alias("up"), F.lit(1.0).alias("low"))
        which = lambda c, x=x, y=y, weak=weak: F.when(weak, F.col(f"{c}{x + 1}")).otherwise(F.col(f"{c}{y + 1}"))
        down = F.struct(which("i").alias("i"), which("v").alias("vec"), F.lit(0.0).alias("up"), (q[z] / F.greatest(q[x], q[y])).alias("low"))
        moves += [F.when(broken & ~against, up), F.when(broken & against, down)]
    each = triangles.select(F.explode(F.array_compact(F.array(*moves))).alias("m")).groupBy("m.i", "m.vec").agg(F.max("m.up").alias("up"), F.min("m.low").alias("low"))
    was = F.get(known, F.col("vec"))
    return each.select("i", "vec", was.alias("p"), F.least(F.greatest(was, F.col("up")), F.col("low")).alias("q"))


def _open(pairs: DataFrame) -> DataFrame:
    """``ca, cb``: records of two tables that both match one of the third, and are no candidates yet, whichever table the third is."""
    likely = pairs.where("p > 0.5").select("ca", "cb", "ta", "tb")
    flipped = likely.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), F.col("tb").alias("ta"), F.col("ta").alias("tb"))
    ends = likely.unionByName(flipped)  # the shared record on the left
    two = ends.join(ends.select("ca", F.col("cb").alias("cc"), F.col("tb").alias("tc")), "ca").where("tb < tc")
    met = two.select(F.col("cb").alias("ca"), F.col("cc").alias("cb")).distinct()
    return met.join(pairs.select("ca", "cb"), ["ca", "cb"], "left_anti")


def _key() -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("fs", "gs", "ks")])


def _numbered(sims: DataFrame, unlike: DataFrame):
    """The pairs with the number of their vector, and the distinct vectors with the number of candidates (``n``) and of pairs that were not made (``m``): a few hundred rows."""
    none = F.lit(0).cast("bigint")
    a = sims.groupBy("fs", "gs", "ks").agg(F.count("*").alias("n")).withColumn("m", none)
    b = unlike.select("fs", F.lit(0.0).alias("gs"), "ks", none.alias("n"), F.col("n").alias("m"))
    pdf = a.unionByName(b).groupBy("fs", "gs", "ks").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).withColumn("_k", _key()).toPandas().sort_values("_k").reset_index(drop=True)
    table = sims.sparkSession.createDataFrame(list(enumerate(pdf["_k"].tolist())), "vec int, _k string")
    joined = sims.withColumn("_k", _key()).join(F.broadcast(table), "_k").drop("_k")  # as many rows as there are distinct rounded vectors
    return written(joined.withColumn("i", F.monotonically_increasing_id())), pdf


def posteriors(sims: DataFrame, unlike: DataFrame, full: DataFrame) -> DataFrame:
    """``ca, cb, p`` of every candidate, by expectation-maximisation under the transitivity constraint."""
    pairs, vectors = _numbered(sims, unlike)
    if vectors.empty:
        return sims.select("ca", "cb", F.lit(0.0).alias("p")).limit(0)
    points = lambda v: v[["fs", "gs", "ks"]].to_numpy(dtype=float)
    weight = lambda v: (v["n"] + v["m"]).to_numpy(dtype=float)
    x = points(vectors)
    mixture = Mixture(x, np.where(np.isnan(x[:, 1]), 0.5, (x[:, 1] >= 0.5).astype(float)), weight(vectors))
    p = mixture.fit()
    while True:  # records that both match a third one become candidates themselves
        known = F.array(*[F.lit(float(v)) for v in p])
        extra = cut(_open(pairs.withColumn("p", F.get(known, F.col("vec")))))
        if extra.isEmpty():
            break
        third = extra.select(F.col("ca").alias("cls_a"), F.col("cb").alias("cls_b")).join(_sided(full, "a"), "cls_a").join(_sided(full, "b"), "cls_b")
        third = compared(third.withColumn("s", _alike(F.col("base_a"), F.col("base_b")))).drop("s")
        pairs, vectors = _numbered(pairs.drop("vec", "i").unionByName(third), unlike)
        mixture.x, mixture.w = points(vectors), weight(vectors)
        p = mixture.expect()
    triangles = written(_triangles(pairs))
    total = weight(vectors)
    for _ in range(MOST_ROUNDS):
        moved = _moved(triangles, p).groupBy("vec").agg(F.sum(F.col("q") - F.col("p")).alias("d")).collect()  # one row a vector
        shift = np.zeros(len(p))
        for r in moved:
            shift[r["vec"]] = r["d"]
        mixture.maximise(np.clip(p + shift / np.maximum(1.0, total), 0.0, 1.0))
        new = mixture.expect()
        settled, p = np.abs(new - p).max() < SETTLED, new
        if settled:
            break
    known = F.array(*[F.lit(float(v)) for v in p])
    final = pairs.join(_moved(triangles, p).select("i", "q"), "i", "left")
    return final.select("ca", "cb", F.coalesce("q", F.get(known, F.col("vec"))).alias("p"))


def all_records(roots: DataFrame, affixes_hf: DataFrame, affixes: DataFrame) -> DataFrame:
    hf = affix_records(affixes_hf, "b", "hf_id", "affix", "meaning", F.col("affix_type"))
    return root_records(roots).unionByName(hf).unionByName(affix_records(affixes, "c", "affix_id", "roots", "meaning"))


def match_classes(roots: DataFrame, affixes_hf: DataFrame, affixes: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``ca, cb, p`` of the classes of equal records that match, and their members ``cls, id``."""
    cls, members = classes(all_records(roots, affixes_hf, affixes))
    cls = written(cls)
    full = _expanded(cls, learn_synonyms(cls))
    sims, unlike = candidates(full)
    return posteriors(written(sims), unlike, full).where(F.col("p") >= least), members


def matched_classes(found: DataFrame, members: DataFrame) -> DataFrame:
    """``id_a, id_b, n_a, n_b, confidence``: pairs of classes, each named by its least id, with their sizes."""
    named = cut(members.groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    pairs = found.join(named.toDF("ca", "id_a", "n_a"), "ca").join(named.toDF("cb", "id_b", "n_b"), "cb")
    return pairs.select("id_a", "id_b", "n_a", "n_b", F.col("p").alias("confidence"))


def class_members(members: DataFrame) -> DataFrame:
    """``id, member``: every record with the least id of its class."""
    return members.join(members.groupBy("cls").agg(F.min("id").alias("least")), "cls").select(F.col("least").alias("id"), F.col("id").alias("member"))


def match(roots: DataFrame, affixes_hf: DataFrame, affixes: DataFrame, least: float = 0.5) -> DataFrame:
    """``id_a, id_b, confidence`` for each pair of records of different tables whose posterior is at least ``least``."""
    found, members = match_classes(roots, affixes_hf, affixes, least)
    pairs = found.join(members.toDF("ca", "ia"), "ca").join(members.toDF("cb", "ib"), "cb")
    return pairs.groupBy(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).agg(F.max("p").alias("confidence"))
