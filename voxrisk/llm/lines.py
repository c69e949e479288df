"""Line dedup: exact and near repeats of lines, found by a segment-partition edit join. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.llm.graphs import maybe_among, narrow, numbered
from voxrisk.llm.sharding import FIRST, ranges_below
from voxrisk.session import compiled_methods, settle, settle_last

THRESHOLD = 2
LETTERS = "etanoirshdlucmgb"  # frequent in the languages of the corpus; any sixteen keep the result
PAIRS_PER_TASK = 1000
CHARS_PER_EDIT = 20  # lines under 20 code points have to be equal, under 40 differ in one edit at most
COPY_WORDS, COPY_PERCENT = 5, 80  # what the near-duplicate stage of the pipeline links: its shingles and its similarity


def edits_allowed(length: Column, threshold: int = THRESHOLD, chars_per_edit: int = CHARS_PER_EDIT) -> Column:
    """Edits between two lines of which the shorter has ``length`` code points."""
    return F.least(F.lit(threshold), F.floor(length / chars_per_edit).cast("int"))


def _segment(length: Column, parts: int, i: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i (from 0) of a line cut into ``parts``; the last ones take the remainder."""
    base, rest = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    short = parts - rest
    return base * i + F.greatest(F.lit(0), i - short), base + (i >= short).cast("int")


def _key(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substr(line, start + 1, size))


def index_keys(line: Column, length: Column, threshold: int, per_edit: int) -> Column:
    """Array of a line's own segments: threshold plus one of them, by length and place."""
    by_edits = F.array().cast("array<bigint>")
    for edits in range(1, threshold + 1):
        parts = edits + 1
        keys = [_key(line, length, i, *_segment(length, parts, i)) for i in range(parts)]
        by_edits = F.when(edits_allowed(length, threshold, per_edit) == edits, F.array(*keys)).otherwise(by_edits)
    return by_edits


def probe_keys(line: Column, length: Column, threshold: int, per_edit: int) -> Column:
    """Array of the substrings where a segment of a line that is equally long or up to ``threshold`` shorter can lie.

    With d the difference in length and e the edits allowed, segment i (from 0) is matched somewhere with at most i edits
    to its left and e - i to its right, so it starts within i of its own place and within e - i of that place moved by d."""
    arrays = []
    for d in range(threshold + 1):
        own = length - d
        by_edits = F.array().cast("array<bigint>")
        for edits in range(max(1, d), threshold + 1):
            keys = []
            for i in range(edits + 1):
                start, size = _segment(own, edits + 1, i)
                for move in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                    keys.append(_key(line, own, i, start + move, size))
            by_edits = F.when(edits_allowed(own, threshold, per_edit) == edits, F.array(*keys)).otherwise(by_edits)
        arrays.append(by_edits)
    return F.array_distinct(F.concat(*arrays))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings, each of at least ``edits`` code points, lie within so many edits.

    Bit-parallel in the band of 2 * edits + 1 diagonals: the vertical differences of a column are the bits of two
    numbers, and one step of additions and shifts makes the next column. The band moves down by a row each
    step; the distance is followed along its lowest diagonal and then along the last row."""
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    chars = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), 0)
    big = lambda n: F.lit(n).cast("bigint")
    inverse = lambda x: x.bitwiseXOR(big(mask))

    def distance(s: Column) -> Column:
        x, y, m = s["x"], s["y"], F.size(s["x"])

        def step(now: Column, j: Column) -> Column:
            here = F.get(y, j)
            equal = big(0)
            for t in range(width):
                equal = equal.bitwiseOR(F.when(F.get(x, j - edits + t) == here, big(1 << t)).otherwise(big(0)))
            vp, vn = now["vp"], now["vn"]

            def differences(d: Column) -> Column:
                hp, hn = vn.bitwiseOR(inverse(d.bitwiseOR(vp))), d.bitwiseAND(vp)
                return F.struct(d.alias("d"), hp.alias("hp"), hn.alias("hn"))

            def moved(v: Column) -> Column:
                low = F.shiftright(v["d"], 1)
                last = F.call_function("shiftright", big(top), F.greatest(F.lit(0), j - (m - edits) + 1))  # the last row's bit
                along = F.when(j < m - edits, F.when(v["d"].bitwiseAND(big(top)) == 0, 1).otherwise(0)).otherwise(
                    F.when(v["hp"].bitwiseAND(last) != 0, 1).when(v["hn"].bitwiseAND(last) != 0, -1).otherwise(0))
                return F.struct(
                    v["hn"].bitwiseOR(inverse(low.bitwiseOR(v["hp"]))).alias("vp"), low.bitwiseAND(v["hp"]).alias("vn"), (now["dist"] + along).alias("dist"))

            diagonal = lambda e: _let((e.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(big(mask)), lambda d: _let(differences(d), moved))
            return _let(equal, diagonal)

        start = F.struct(big(mask ^ ((1 << edits) - 1)).alias("vp"), big(0).alias("vn"), F.lit(edits).alias("dist"))
        return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), start, step, lambda end: end["dist"])

    near = F.abs(F.length(a) - F.length(b)) <= edits
    return near & (_let(F.struct(chars(a).alias("x"), chars(b).alias("y")), distance) <= edits)


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, t, pos, line, k, k2) of every line that is not blank; lines are compared without the spaces at their ends.

    (doc, t) is the row's id and a hash of its text, (k, k2) 128 bits of hash of the line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST)).alias("doc"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''").withColumn("k", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(9), "line"))


def letter_counts(line: Column) -> Column:
    """How often each of sixteen letters occurs, modulo 16, packed into a long."""
    packed = F.lit(0).cast("bigint")
    for i, letter in enumerate(LETTERS):
        count = (F.length(line) - F.length(F.replace(line, F.lit(letter)))) % 16
        packed = packed.bitwiseOR(F.shiftleft(count.cast("bigint"), 4 * i))
    return packed


def counts_apart(a: Column, b: Column) -> Column:
    """Sum of the differences of letter counts; an edit changes it by two at most."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        count = lambda x: F.shiftright(x, 4 * i).bitwiseAND(F.lit(15).cast("bigint"))  # noqa: E731, B023
        apart = F.abs(count(a) - count(b))
        total = total + F.least(apart, 16 - apart)
    return total


def near_lines(lines: DataFrame, threshold: int = THRESHOLD, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Links (a, b) of line hashes k whose texts differ but lie within the edits allowed. ``lines``: line, k, each text once.

    Index and probe keys are joined on their hash without the texts. A line's index keys are among its own probe keys, so a key
    that one line alone probes links nothing; such keys, nearly all, go after counting. Only lines that share a key with another get
    letter counts, and pairs whose counts alone tell that they are further apart are dropped by the join itself, so many lines that
    share a segment but differ elsewhere make few rows. Only lines that have a candidate are fetched and compared."""
    line, length = F.col("line"), F.col("length")
    plain = F.octet_length("line") == length  # one byte a character: segments are cut without counting characters

    def cut(keys) -> Column:
        return F.when(plain, keys(F.col("bytes"), length, threshold, chars_per_edit)).otherwise(keys(line, length, threshold, chars_per_edit))

    # the texts are read, counted and cut once; the keys of both sides are exploded from what is written
    sized = lines.select("k", "line", F.length("line").alias("length"), line.cast("binary").alias("bytes")).where(length >= chars_per_edit)
    keys = settle(sized.select("k", cut(index_keys).alias("index"), cut(probe_keys).alias("probes")), "line-keys")
    index, probes = (keys.select("k", F.explode(side).alias("key")) for side in ("index", "probes"))
    shared = settle(probes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "line-shared")
    index = settle(narrow(index, "key", shared, "key").join(shared, "key", "left_semi"), "line-index")
    met = settle(index.select("key").distinct(), "line-met")
    probes = settle(narrow(probes, "key", met, "key").join(met, "key", "left_semi"), "line-probes")
    meeting = settle(probes.select(F.col("k").alias("w")).distinct(), "line-meeting")
    counts = settle(narrow(lines.select("k", "line"), "k", meeting, "w").select("k", letter_counts(line).alias("counts")).distinct(), "line-counts")
    other = probes.join(counts, "k").select("key", F.col("k").alias("other"), F.col("counts").alias("other_counts"))
    near = (F.col("k") != F.col("other")) & (counts_apart(F.col("counts"), F.col("other_counts")) <= 2 * threshold)
    met = index.join(counts, "k").join(other, "key").where(near)
    pairs = settle(met.select(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b")).distinct(), "line-pairs")
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    texts = settle(narrow(lines.select("k", "line"), "k", wanted, "w").distinct(), "line-texts")
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("k").alias("b"), F.col("line").alias("y")), "b")
    both = both.repartition(max(1, math.ceil(pairs.count() / PAIRS_PER_TASK)))  # little data, but much work
    allowed = edits_allowed(F.least(F.length("x"), F.length("y")), threshold, chars_per_edit)
    close = F.lit(False)
    for edits in range(1, threshold + 1):
        # Spark's compiled distance gives up early on pairs that are far apart; what it lets through the bits decide
        apart = F.levenshtein("x", "y", edits) < 0
        close = F.when(allowed == edits, ~apart & within_edits(F.col("x"), F.col("y"), edits)).otherwise(close)
    return both.where(close).select("a", "b")


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose numbers, sorted, are in ``gone``."""
    # each line looks itself up by halving
    goes = lambda i: F.get(gone, ranges_below(gone, i, 1 << 30) - 1) == i
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.coalesce(goes(i), F.lit(False))), "\n")


def shingle_hashes(text: Column, words: int = COPY_WORDS) -> Column:
    """Hashes of the distinct runs of so many words, of the whole text if it is shorter, by the rule of near-duplicates."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - words + 1)), lambda i: F.xxhash64(F.slice(w, i, words)))
    return _let(found, lambda w: F.when(F.size(w) > 0, F.array_distinct(runs(w))).otherwise(F.array().cast("array<bigint>")))


def spared_rows(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, t) of the rows that are near-duplicates of the row ``of``, with which they share lines.

    ``rows``: doc, t, sure (lines that go in any case), open (lines that go unless the row is spared), of. Compared is what is left of
    both rows; whether ``of`` itself is spared is not known here, so both cases have to be similar enough."""
    judged = rows.where(F.size("open") > 0)
    wanted = judged.select("t").union(judged.select("of.t")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST)).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))
    numbers = lambda c: F.coalesce(F.transform(c, lambda r: r["pos"]), F.array().cast("array<int>"))
    left = lambda gone: shingle_hashes(_let(F.array_sort(gone), lambda g: without_lines(F.col("text"), g)))
    whole, rest = left(numbers("sure")), left(F.concat(numbers("sure"), numbers("open")))
    judge = lambda ids: narrow(texts, "t", settle(ids, "line-wanted"), "t").join(rows.drop("of"), ["doc", "t"], "left")
    # rows too unlike in size are told apart by numbers; sets are made of the others only
    sizes = settle(judge(wanted).select("doc", "t", F.size(whole).alias("n"), F.size(rest).alias("m")).distinct(), "line-sizes")
    other = sizes.select(F.struct("doc", "t").alias("of"), F.col("n").alias("of_n"), F.col("m").alias("of_m"))
    like = lambda x: (F.col("n") > 0) & (100 * F.least("n", x) >= COPY_PERCENT * F.greatest("n", x))
    pairs = judged.select("doc", "t", "of").join(sizes.select("doc", "t", "n"), ["doc", "t"]).join(other, "of").where(like("of_n") & like("of_m"))
    pairs = settle(pairs, "line-alike")
    ends = settle(pairs.select("doc", "t").union(pairs.select("of.doc", "of.t")).distinct(), "line-ends")
    found = judge(ends.select("t").distinct()).join(ends, ["doc", "t"], "left_semi").dropDuplicates(["doc", "t"])
    sets = settle(found.select("doc", "t", whole.alias("whole"), F.when(F.size("open") > 0, rest).alias("rest")), "line-sets")
    of_sets = sets.select(F.struct("doc", "t").alias("of"), F.col("whole").alias("a"), F.coalesce("rest", "whole").alias("b"))
    met = pairs.join(narrow(sets.select("doc", "t", "whole"), "t", pairs, "t"), ["doc", "t"]).join(of_sets, "of")
    both = met.select("doc", "t", "n", "of_n", "of_m", F.size(F.array_intersect("whole", "a")).alias("in_n"), F.size(F.array_intersect("whole", "b")).alias("in_m"))
    enough = lambda c, size: 100 * F.col(c) >= COPY_PERCENT * (F.col("n") + F.col(size) - F.col(c))
    return both.where(enough("in_n", "of_n") & enough("in_m", "of_m")).select("doc", "t")


def line_decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, chars_per_edit: int = CHARS_PER_EDIT,
    min_places: int = 2, spare_copies: bool = False,
) -> DataFrame:
    """(doc, t, exact, near, gone) of every row that loses lines: counts, and the sorted numbers of the lines that go.

    A line goes as exact if the same line stands earlier, in order of (id, text hash, line number), and as near if its
    first place is later than that of a different line within the edits allowed. The rule looks at direct links only,
    so long chains of small changes don't fall together. With ``min_places`` over 2, a line of another document goes only if it
    and the line that it repeats stand in so many places. With ``spare_copies`` the lines that a row shares with the earlier row with
    which it shares most stay if both, without their other repeated lines, are near-duplicates (see spared_rows): that is a copy of a
    document, to be judged as a whole. Repeats in one row always go."""
    lines = line_rows(docs, id_col, text_col)
    # the least of each part is the place of a line that stands in one, as most do; numbers alone are summed up without sorting
    held = settle(lines.groupBy("k", "k2").agg(*[F.min(x).alias(x) for x in ("doc", "t", "pos")], F.count("*").alias("n")), "line-held")
    marked = maybe_among(lines, "k", held.where("n > 1"), "k")
    several = settle(marked.where("_maybe").select("doc", "t", "pos", "line", "k", "k2"), "line-several")
    once = marked.where("NOT _maybe").select("line", "k").unionByName(several.select("line", "k").distinct())
    place = F.struct("doc", "t", "pos")
    again = several.groupBy("k", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    known = held.where("n = 1").select("k", "k2", place.alias("first"), "n").unionByName(settle(again, "line-again"))
    links = settle_last(docs.sparkSession, lambda: near_lines(once, threshold, chars_per_edit), "line-links")
    ends = links.select("a", "b").union(links.select("b", "a"))
    side = lambda x: known.select(F.col("k").alias(x), F.col("first").alias(f"first_{x}"), F.col("n").alias(f"n_{x}"))
    linked = ends.join(side("a"), "a").join(side("b"), "b").where("first_b < first_a")
    later = linked.groupBy(F.col("a").alias("k")).agg(F.min("first_b").alias("of"), F.max(F.col("n_a") + F.col("n_b")).alias("places"))
    repeated = known.join(later, "k", "left").where("n > 1 OR of IS NOT NULL")
    repeated = settle(repeated.select(
        "k", "k2", "first", F.coalesce("of", "first").alias("of"), F.coalesce("places", "n").alias("places"), F.col("of").isNotNull().alias("near")), "line-repeated")
    places = narrow(lines.select("doc", "t", "pos", "k", "k2", F.length("line").alias("size")), "k", repeated, "k").join(repeated, ["k", "k2"])
    gone = places.where((F.struct("doc", "t", "pos") != F.col("first")) | F.col("near"))
    # a line that is a repeat inside the row of its first place goes from copies of that row too
    of = F.struct("of.doc", "of.t")
    inside = (F.struct("doc", "t") == of) | (F.col("near") & (F.struct("first.doc", "first.t") == of))
    if spare_copies or min_places > 2:
        spots = gone.groupBy("doc", "t", "k", "k2", "near", "size", "places", of.alias("of"), inside.alias("inside")).agg(F.array_sort(F.collect_set("pos")).alias("at"))
        spots = spots.withColumn("common", F.col("places") >= min_places)
        numbered = lambda at: F.transform(at, lambda p: F.struct(p.alias("pos"), F.col("near").alias("near")))
        none = F.slice("at", 1, 0)
        # of a line that stands first elsewhere, the row's first place may be spared, its further ones repeat that
        spots = spots.withColumn("sure", numbered(F.when(F.col("inside"), F.col("at")).otherwise(F.slice("at", F.lit(2), F.size("at")))))
        spots = spots.withColumn("open", numbered(F.when(~F.col("inside") & F.col("common"), F.slice("at", 1, 1)).otherwise(none)))
        by_row = spots.groupBy("doc", "t", "of").agg(
            F.sum(F.when(F.size("open") > 0, F.col("size")).otherwise(0)).alias("shared"),
            F.flatten(F.collect_list("sure")).alias("sure"), F.flatten(F.collect_list("open")).alias("open"))
        rows = by_row.groupBy("doc", "t").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("less"), "of", "sure", "open"))).alias("from"))
        most, others = F.get("from", 0), F.slice("from", F.lit(2), F.size("from"))
        rows = rows.select(
            "doc", "t", most["of"].alias("of"), most["open"].alias("open"),
            F.concat(F.flatten(F.transform("from", lambda f: f["sure"])), F.flatten(F.transform(others, lambda f: f["open"]))).alias("sure"))
        rows = settle(rows, "line-rows")
        every = F.concat("sure", "open")
        if spare_copies:
            copies = rows
            spared = settle_last(docs.sparkSession, lambda: spared_rows(docs, copies, id_col, text_col).withColumn("spared", F.lit(True)), "line-spared")
            rows = rows.join(spared, ["doc", "t"], "left")
            every = F.when(F.col("spared"), F.col("sure")).otherwise(every)
        flat = rows.select("doc", "t", every.alias("rows")).where(F.size("rows") > 0)
    else:
        gone = gone.select("doc", "t", "pos", "near", "places", of.alias("of")).distinct()
        by_row = gone.groupBy("doc", "t", "of").agg(F.array_sort(F.collect_list(F.struct("pos", "near", "places"))).alias("rows"))
        flat = by_row.groupBy("doc", "t").agg(F.flatten(F.collect_list("rows")).alias("rows"))
    near = F.size(F.filter("rows", lambda r: r["near"]))
    return flat.select("doc", "t", (F.size("rows") - near).alias("exact"), near.alias("near"), F.array_sort(F.transform("rows", lambda r: r["pos"])).alias("gone"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, chars_per_edit: int = CHARS_PER_EDIT,
    min_places: int = 2, spare_copies: bool = False,
) -> DataFrame:
    """``docs`` without repeated lines, with n_lines (blank ones not counted), n_exact and n_near (lines that went).

    See line_decisions for the rule. Blank lines stay where they are. A null text stays null, an empty one empty; a
    text of which every line goes becomes empty. Rows with a null id come first in order. Rows with one id and
    one text are one document and are treated alike. Columns named like the three counts are replaced. Jobs run
    when this is called."""
    with compiled_methods(docs.sparkSession):
        decisions = settle_last(
            docs.sparkSession, lambda: line_decisions(docs, id_col, text_col, threshold, chars_per_edit, min_places, spare_copies), "line-decisions")
    given = docs.drop("n_lines", "n_exact", "n_near")
    held = numbered(given)
    id_, text_ = (F.col(held.columns[given.columns.index(c)]) for c in (id_col, text_col))
    text = F.coalesce(text_, F.lit(""))
    keyed = held.withColumn("doc", F.coalesce(id_.cast("bigint"), F.lit(FIRST))).withColumn("t", F.xxhash64(text))
    # most rows of a clean corpus lose nothing; they are not moved
    maybe = maybe_among(keyed, "t", decisions, "t")
    rest = maybe.where("_maybe").join(decisions, ["doc", "t"], "left")
    marked = rest.unionByName(maybe.where("NOT _maybe"), allowMissingColumns=True)
    kept = F.when(F.col("gone").isNull(), text_).otherwise(without_lines(text, F.col("gone")))
    return marked.select(
        *[(kept if name == text_col else F.col(c)).alias(name) for c, name in zip(held.columns, given.columns)],
        F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("n_lines"),
        F.coalesce("exact", F.lit(0)).cast("bigint").alias("n_exact"), F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"))


def drop_repeated_lines(docs: DataFrame, min_places: int = 2) -> DataFrame:
    """Documents without the lines that the corpus repeats, columns as they came (n_chars counted anew). Documents that
    are left without any text by that go; copies of whole documents stay whole, for a near-duplicate stage to judge."""
    held = numbered(docs)
    place = {name: c for c, name in zip(held.columns, docs.columns)}
    out = dedup_lines(held, place["doc_id"], place["text"], min_places=min_places, spare_copies=True)
    left = out.where(~((F.col("n_exact") + F.col("n_near") > 0) & (F.trim(place["text"]) == "")))
    if "n_chars" in place:
        left = left.withColumn(place["n_chars"], F.length(place["text"]).cast(docs.schema["n_chars"].dataType))
    return left.select(*held.columns).toDF(*docs.columns)
