"""Product entity resolution: features of names, pair rules, clusters and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import without_accents
from ..session import with_checkpoints

#: Words of product names by what they say. (Fixed values.)
GEAR = "at mt aut man automatic manual cvt 4wd awd 2wd fwd rwd 4x4 4x2 4motion quattro xdrive allgrip".split()
GEAR_PATTERN = r"^\d?(e?dct|dsg|at|mt|cvt)\d?$"
FILLER = "fl facelift new novi nova turbo mild scr adblue euro6 euro6d start/stop".split()
DIESEL = "diesel tdi crdi dci hdi bluehdi cdti cdi jtd multijet".split()
PETROL = "petrol benzin tsi tfsi tgdi gdi tce puretech ecoboost vvti skyactiv mpi".split()
HYBRID = "hybrid ehybrid hev mhev".split()
PLUG_IN = "phev".split()
ELECTRIC = "ev electric bev electro".split()
HP_TO_KW = 0.7355
POWER_TOLERANCE = 0.04
AUTO_CONFIRM_ROUNDS = 5
#: Kinds of names with one brand and words that a round decides.
REGROUP_STEP = 256

FEATURES = ("years", "disp", "power", "gear", "combustion", "electrified", "words")


def name_tokens(identity: Column) -> Column:
    plain = F.lower(without_accents(identity))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\+", " plus "), "/", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\d)\s+(kw|hp|ps|ks)\b", "$1$2"), "-", "")
    return F.filter(F.split(plain, r"\s+"), lambda t: t != "")


def with_features(names: DataFrame, identity: str = "identity") -> DataFrame:
    """`names` with brand, the FEATURES arrays and detail. Give distinct names: each is analysed once."""
    rows = names.withColumn("tokens", name_tokens(F.col(identity)))
    rest = F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0)))
    among = lambda words: (lambda t: t.isin(words))
    year = lambda t: t.rlike(r"^(19|20)\d{2}$")
    disp = lambda t: t.rlike(r"^\d\.\d[a-z]*$")
    power = lambda t: t.rlike(r"^\d{2,4}(kw|hp|ps|ks)?$") & ~t.rlike(r"^\d{4}$")
    gear = lambda t: t.isin(GEAR) | t.rlike(GEAR_PATTERN)
    earlier = lambda *tests: (lambda t: ~_any(test(t) for test in tests))
    number = lambda t: F.regexp_extract(t, r"^\d+", 0).cast("double")
    fuel = lambda t: F.when(t.isin(DIESEL), "diesel").when(t.isin(PETROL), "petrol")
    current = lambda t: F.when(t.isin(HYBRID), "hybrid").when(t.isin(PLUG_IN), "phev").when(t.isin(ELECTRIC), "ev")
    named = lambda t: ~(year(t) | disp(t) | power(t) | gear(t) | fuel(t).isNotNull() | current(t).isNotNull() | among(FILLER)(t))
    ordered = lambda a: F.array_sort(F.array_distinct(a))
    rows = rows.select(
        *names.columns,
        F.coalesce(F.get("tokens", F.lit(0)), F.lit("")).alias("brand"),
        ordered(F.filter(rest, year)).alias("years"),
        ordered(F.transform(F.filter(rest, lambda t: disp(t)), lambda t: F.regexp_replace(t, "l$", ""))).alias("disp"),
        F.transform(F.filter(rest, lambda t: power(t) & earlier(year, disp)(t)), lambda t: F.when(t.endswith("kw"), number(t)).otherwise(number(t) * HP_TO_KW)).alias("power"),
        ordered(F.filter(rest, lambda t: gear(t) & earlier(year, disp, power)(t))).alias("gear"),
        ordered(F.array_compact(F.transform(F.filter(rest, earlier(year, disp, power, gear)), fuel))).alias("combustion"),
        ordered(F.array_compact(F.transform(F.filter(rest, earlier(year, disp, power, gear)), current))).alias("electrified"),
        ordered(F.filter(rest, named)).alias("words"),
    )
    return rows.withColumn("detail", sum((F.size(c) for c in FEATURES[1:]), F.size(FEATURES[0])))


def _any(tests) -> Column:
    found = F.lit(False)
    for t in tests:
        found = found | t
    return found


def specs_compatible(a: str, b: str) -> Column:
    """Nothing two names state contradicts; `a` and `b` are aliases of feature rows."""
    col = lambda s, c: F.col(f"{s}.{c}")
    agree = (col(a, "brand") != "") & (col(a, "brand") == col(b, "brand"))
    for c in ("years", "disp", "gear", "combustion", "electrified"):
        agree = agree & ((F.size(col(a, c)) == 0) | (F.size(col(b, c)) == 0) | (col(a, c) == col(b, c)))
    near = lambda xs, ys: F.forall(xs, lambda x: F.exists(ys, lambda y: F.abs(x - y) <= POWER_TOLERANCE * F.greatest(x, y)))
    pa, pb = col(a, "power"), col(b, "power")
    return agree & ((F.size(pa) == 0) | (F.size(pb) == 0) | (near(pa, pb) & near(pb, pa)))


def same_product(a: str, b: str) -> Column:
    return specs_compatible(a, b) & (F.col(f"{a}.words") == F.col(f"{b}.words"))


def maybe_same_product(a: str, b: str) -> Column:
    """Compatible, and one name's words are all among the other's, which has more."""
    wa, wb = F.col(f"{a}.words"), F.col(f"{b}.words")
    within = lambda x, y: (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)
    return specs_compatible(a, b) & (wa != wb) & F.when(F.size(wa) <= F.size(wb), within(wa, wb)).otherwise(within(wb, wa))


def same_pairs(features: DataFrame, identity: str = "identity") -> DataFrame:
    """(a, b), a < b: certainly the same product. Joined on brand and words, which equal pairs share, so a brand is no group of its own."""
    a, b = features.alias("a"), features.alias("b")
    return a.join(b, (F.col("a.brand") == F.col("b.brand")) & (F.col("a.words") == F.col("b.words")) & (F.col(f"a.{identity}") < F.col(f"b.{identity}")) & same_product("a", "b")).select(F.col(f"a.{identity}").alias("a"), F.col(f"b.{identity}").alias("b"))


def maybe_pairs(features: DataFrame, identity: str = "identity") -> DataFrame:
    """(general, specific) of possible matches. The general name's rarest word must be among the specific one's: the join goes by brand
    and that word, not by brand alone."""
    words = features.select("brand", identity, F.explode("words").alias("word"))
    known = words.groupBy("brand", "word").agg(F.count("*").alias("n"))
    rarest = words.join(known, ["brand", "word"]).groupBy(identity).agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    a = features.join(rarest, identity).alias("a")
    b = features.withColumn("word", F.explode("words")).alias("b")
    pairs = a.join(b, (F.col("a.brand") == F.col("b.brand")) & (F.col("a.word") == F.col("b.word")) & (F.size("a.words") < F.size("b.words")) & maybe_same_product("a", "b"))
    return pairs.select(F.col(f"a.{identity}").alias("general"), F.col(f"b.{identity}").alias("specific"))


def _conflicts(nodes: DataFrame, rejections: DataFrame) -> DataFrame:
    """(low, low_rank, high, rank) of kinds of one block that can't stand in one group; nodes: (id, own, rank, features)."""
    told = rejections.select(F.col("a").alias("x"), F.col("b").alias("y")).union(rejections.select("b", "a")).distinct()
    low, high = nodes.alias("a"), nodes.alias("b")
    pairs = low.join(high, (F.col("a.brand") == F.col("b.brand")) & (F.col("a.words") == F.col("b.words")) & (F.col("a.rank") < F.col("b.rank")))
    pairs = pairs.join(told, (F.col("a.own") == F.col("x")) & (F.col("b.own") == F.col("y")), "left").where(~specs_compatible("a", "b") | F.col("x").isNotNull())
    return pairs.select(F.col("a.id").alias("low"), F.col("a.rank").alias("low_rank"), F.col("b.id").alias("high"), F.col("b.rank").alias("rank"))


def _first_free(taken: Column) -> Column:
    """The least number from 0 that isn't taken."""
    return F.array_min(F.array_except(F.sequence(F.lit(0), F.size(taken)), taken))


def regroup(names: DataFrame, rejections: DataFrame | None = None, step: int = REGROUP_STEP) -> DataFrame:
    """(identity, canonical): names grouped so that every two of a group are certainly the same product and none was told apart.

    names: distinct `identity`; rejections: pairs (a, b). Complete linkage, greedy from the most specific name (detail, length, then by
    name), which becomes the canonical one. A name joins the first group in which nothing contradicts it. So, with groups of equal brand and words
    numbered by their first names, a name's group is the least number that no earlier name contradicting it has: it depends on those alone.

    Names that state the same and were never told apart have the same group, so kinds of names are decided, not names: those of one
    brand and words are as many as there are ways to state years, engines and gears. Each round decides the next `step` kinds of
    all brands and words at once, from what the earlier rounds decided.
    """
    with_checkpoints(names.sparkSession)
    if rejections is None:
        rejections = names.sparkSession.createDataFrame([], "a string, b string")
    told = rejections.select(F.col("a").alias("identity")).union(rejections.select("b")).distinct().withColumn("own", F.col("identity"))
    rows = with_features(names.select("identity").distinct()).join(told, "identity", "left")
    order = F.struct((-F.col("detail")).alias("d"), (-F.char_length("identity")).alias("n"), "identity")
    rows = rows.withColumns({"order": order, "kind": F.to_json(F.struct("brand", *FEATURES, "own"))}).checkpoint()

    nodes = rows.where("brand <> ''").groupBy("kind").agg(F.min("order").alias("order"), *(F.any_value(c).alias(c) for c in ("brand", "own", *FEATURES)))
    rank = F.row_number().over(Window.partitionBy("brand", "words").orderBy("order")) - 1
    nodes = nodes.withColumns({"rank": rank, "id": F.col("order.identity")}).checkpoint()
    conflicts = _conflicts(nodes, rejections).checkpoint()
    last = nodes.agg(F.max("rank")).first()[0]

    decided = nodes.select("id", F.lit(0).alias("number")).limit(0)
    for start in range(0, (last if last is not None else -1) + 1, step):
        now = F.col("rank").between(start, start + step - 1)
        mine = conflicts.where(now)
        earlier = mine.where(F.col("low_rank") < start).join(decided, F.col("low") == F.col("id")).groupBy(F.col("high").alias("id")).agg(F.collect_set("number").alias("taken"))
        together = mine.where(F.col("low_rank") >= start).groupBy(F.col("high").alias("id")).agg(F.collect_list(F.col("low_rank") - start).alias("before"))
        empty = F.array().cast("array<int>")
        each = nodes.where(now).join(earlier, "id", "left").join(together, "id", "left")
        each = each.select("brand", "words", F.struct("rank", "id", F.coalesce("taken", empty).alias("taken"), F.coalesce("before", empty).alias("before")).alias("x"))
        blocks = each.groupBy("brand", "words").agg(F.array_sort(F.collect_list("x")).alias("x"))
        put = lambda numbers, x: F.concat(numbers, F.array(_first_free(F.array_union(x["taken"], F.transform(x["before"], lambda i: F.get(numbers, i))))))
        numbered = blocks.select(F.explode(F.arrays_zip(F.col("x.id").alias("id"), F.aggregate("x", empty, put).alias("number"))).alias("z")).select("z.id", "z.number")
        decided = decided.unionByName(numbered).checkpoint()

    groups = nodes.join(decided, "id").select("kind", "brand", "words", "number", "order")
    heads = groups.groupBy("brand", "words", "number").agg(F.min("order").alias("head"))
    canonical = groups.join(heads, ["brand", "words", "number"]).select("kind", F.col("head.identity").alias("canonical"))
    return rows.join(canonical, "kind", "left").select("identity", F.coalesce("canonical", "identity").alias("canonical"))


def suggestions(items: DataFrame, aliases: DataFrame, rejections: DataFrame | None = None) -> DataFrame:
    """(identity, candidates): general product names and the more specific ones they may mean, most listings first.

    items: (identity); aliases: (identity, canonical). Rejected pairs, of any two names of the products, are left out.
    """
    named = items.join(aliases, "identity", "left").withColumn("root", F.coalesce("canonical", "identity")).where(F.coalesce("root", F.lit("")) != "")
    listed = named.groupBy("root").agg(F.count("*").alias("listings"))
    pairs = maybe_pairs(with_features(listed.select(F.col("root").alias("identity"))))
    if rejections is not None:
        members = named.select("root", "identity").union(listed.select("root", "root")).distinct()
        told = rejections.select("a", "b").union(rejections.select("b", "a"))
        told = told.join(members.select(F.col("identity").alias("a"), F.col("root").alias("general")), "a").join(members.select(F.col("identity").alias("b"), F.col("root").alias("specific")), "b")
        pairs = pairs.join(told.select("general", "specific").distinct(), ["general", "specific"], "left_anti")
    pairs = pairs.join(listed.withColumnRenamed("root", "specific"), "specific")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("listings")).alias("order"), "specific")))
    return pairs.groupBy(F.col("general").alias("identity")).agg(F.transform(ordered, lambda c: c["specific"]).alias("candidates"))


def auto_confirm(items: DataFrame, aliases: DataFrame, rejections: DataFrame | None = None, rounds: int = AUTO_CONFIRM_ROUNDS) -> DataFrame:
    """Aliases after every suggestion with one candidate was taken, as often as that reveals new ones, up to `rounds` times."""
    with_checkpoints(items.sparkSession)
    for _ in range(rounds):
        single = suggestions(items, aliases, rejections).where(F.size("candidates") == 1).select(F.col("identity").alias("canonical"), F.get("candidates", F.lit(0)).alias("to"))
        # one step a round: a name that others are to join stays where it is until the next
        single = single.join(single.select(F.col("to").alias("canonical")).distinct(), "canonical", "left_anti").checkpoint()
        if not single.take(1):
            break
        moved = aliases.join(single, "canonical", "left").select("identity", F.coalesce("to", "canonical").alias("canonical"))
        fresh = single.select(F.col("canonical").alias("identity"), F.col("to").alias("canonical")).join(moved, "identity", "left_anti")
        aliases = moved.unionByName(fresh).checkpoint()
    return aliases


def product_groups(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(canonical, listings, titles): products, the largest first, then by name."""
    named = items.join(aliases, "identity", "left").withColumn("canonical", F.coalesce("canonical", F.nullif("identity", F.lit("")), F.lower(F.btrim("title"))))
    return named.groupBy("canonical").agg(F.count("*").alias("listings"), F.array_sort(F.collect_set("title")).alias("titles")).orderBy(F.desc("listings"), "canonical")


def same_product_listings(items: DataFrame, aliases: DataFrame, top: int = 20) -> DataFrame:
    """(id, other, total): for each item the other listings of its product, active ones first, then the newest.

    A product's listings are put in order once, and each listing meets the first top + 1 of them only.
    """
    named = items.join(aliases, "identity", "left").withColumn("root", F.coalesce("canonical", "identity")).where(F.coalesce("root", F.lit("")) != "").select("id", "root", "gone_at", "indexed_at")
    order = Window.partitionBy("root").orderBy(F.col("gone_at").isNotNull(), F.desc("indexed_at"), "id")
    placed = named.withColumn("place", F.row_number().over(order))
    first = placed.where(F.col("place") <= top + 1).select("root", F.col("id").alias("other"), F.col("place").alias("at"))
    counts = named.groupBy("root").agg((F.count("*") - 1).alias("total"))
    pairs = placed.select("id", "root", "place").join(first, "root").where("id <> other").join(counts, "root")
    # a listing among the first ones leaves room for one more
    return pairs.where(F.col("at") <= top + F.when(F.col("place") <= top, 1).otherwise(0)).select("id", "other", "total")


#: Words of attribute names that carry no meaning of their own, or the same one. (Fixed values.)
UNIT_WORDS = "kw hp ps cc ccm l liters litres kg mm cm m inch km gb tb mah w years months s".split()
FILLER_WORDS = "power capacity volume size number of count total type system function feature with and".split()
SYNONYMS = {"trunk": "boot", "cargo": "boot", "luggage": "boot", "kerb": "curb", "maximum": "max", "top": "max", "mass": "weight"}
QUALIFIERS = (
    "adaptive heated cooled ventilated front rear panoramic automatic electric manual digital led xenon sport split memory high low remote curtain side knee central"
).split()


def name_words(key: Column) -> Column:
    """The meaningful words of an attribute name."""
    synonym = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    words = F.transform(F.transform(F.split(key, "_"), lambda t: F.regexp_replace(t, "s$", "")), lambda t: F.coalesce(synonym[t], t))
    return F.array_distinct(F.filter(words, lambda t: (t != "") & ~t.isin(UNIT_WORDS + FILLER_WORDS)))


def names_related(a: Column, b: Column, exact: Column | None = None) -> Column:
    """Whether two attribute names may mean the same: the shorter one's words all in the longer one, which adds at most one that qualifies
    nothing; where `exact`, equal words."""
    x, y = name_words(a), name_words(b)
    common = F.size(F.array_intersect(x, y))
    small, big = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    qualifiers = F.array(*map(F.lit, QUALIFIERS))
    one_sided = F.array_union(F.array_except(x, y), F.array_except(y, x))
    loose = (common == small) & (big - small <= 1) & ~F.arrays_overlap(one_sided, qualifiers)
    strict = (common == F.size(x)) & (common == F.size(y))
    return (small > 0) & (common > 0) & (loose if exact is None else F.when(exact, strict).otherwise(loose))
