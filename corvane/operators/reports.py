"""Bank reports, practice pools, samples, numbers and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.ranks import ranked, running_total
from corvane.functions.storage import written


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""


def item_flags(items: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """items with is_mcq, is_matching, has_image, is_synthetic (the document's name starts with _), status (unvalidated by default), context_key and the document's edited_at."""
    joined = items.join(meta.select(key, F.col("edited_at").alias("doc_edited_at")), key, "left")
    return joined.withColumns({
        "is_mcq": F.size(F.coalesce("choices", F.array().cast("array<string>"))) > 0,
        "is_matching": F.coalesce(F.col("qtype") == "matching", F.lit(False)),
        "has_image": F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0,
        "is_synthetic": F.col(key).startswith("_"),
        "status": F.coalesce("status", F.lit("unvalidated")),
        "context_key": F.when(F.col("context_id").isNotNull(), F.concat_ws("::", key, F.col("context_id").cast("string"))),
    })


def practice_pool(items: DataFrame, topic: str | None = None, kind: str | None = None, origin: str | None = None) -> DataFrame:
    """Items with a recorded answer (matching ones: a pair), of the topic, kind (mcq, matching, frq) and origin (pdf, generated, scraped by the document's name) asked for."""
    doc = F.col("doc")
    origins = F.when(doc.startswith("_generated"), "generated").when(doc.startswith("_scraped"), "scraped").otherwise("pdf")
    kinds = F.when(F.col("qtype") == "matching", "matching").when(F.size(F.coalesce("choices", F.array().cast("array<string>"))) > 0, "mcq").otherwise("frq")
    tests = [F.when(kinds == "matching", F.size(F.coalesce("pairs", F.create_map().cast("map<string,string>"))) > 0).otherwise(_filled("answer"))]
    tests += [F.col("topic") == topic] * (topic is not None) + [kinds == kind] * (kind is not None) + [origins == origin] * (origin is not None)
    return items.where(reduce(lambda a, b: a & b, tests))


def builder_pool(items: DataFrame, keys: list[str], kept: DataFrame, search: str = "", topic: str | None = None, kind: str | None = None, most: int = 100) -> DataFrame:
    """The first most items by their keys that are verified as correct, not kept yet, of the topic and kind, and contain the search text in either case; the limit is a page."""
    tests = [F.col("status") == "correct", F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(search.lower()))]
    tests += [F.col("topic") == topic] * (topic is not None) + [F.col("qtype") == kind] * (kind is not None)
    return items.where(reduce(lambda a, b: a & b, tests)).join(kept.select(*keys), keys, "left_anti").orderBy(*keys).limit(most)


def clean_items(items: DataFrame) -> DataFrame:
    """items as they are saved: texts trimmed, a blank topic is Other / General, choices upper-case and none empty, page a number or null."""
    choices = F.filter(F.transform("choices", lambda c: F.struct(F.upper(F.trim(c["letter"])).alias("letter"), F.trim(c["text"]).alias("text"))), lambda c: c["text"] != "")
    return items.withColumns({"text": F.trim("text"), "answer": F.trim("answer"), "topic": F.when(_filled("topic"), F.trim("topic")).otherwise("Other / General"), "choices": choices, "page": F.trim("page").try_cast("int")})


def pair_verdict(pairs: Column) -> Column:
    """uncertain without pairs, correct where all are ok, else incorrect."""
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, "uncertain").when(F.forall(pairs, lambda p: F.coalesce(p, F.lit(False))), "correct").otherwise("incorrect")


def doc_status(files: DataFrame, items: DataFrame, key: str, has_image: Column, has_answer: Column) -> DataFrame:
    """(key, items, images, answers, processed): counts of every file's items; a file without items is not processed."""
    counts = items.groupBy(key).agg(F.count("*").alias("items"), F.count_if(has_image).alias("images"), F.count_if(has_answer).alias("answers"))
    zero = F.lit(0)
    out = files.select(key).join(counts, key, "left")
    return out.select(key, F.coalesce("items", zero).alias("items"), F.coalesce("images", zero).alias("images"), F.coalesce("answers", zero).alias("answers"), F.col("items").isNotNull().alias("processed"))


#: What a status page is sorted by, under the names that callers use; anything else sorts by name.
STATUS_SORTS = {"questions": "items", "images": "images", "answers": "answers", "size": "size", "mtime": "mtime"}


def status_page(status: DataFrame, edited: DataFrame, keyed: DataFrame, key: str, sort: str = "name", descending: bool = False) -> DataFrame:
    """doc_status's rows with edited (the document has manual edits) and has_key (it has a key file), sorted; equal rows by name, whatever the direction."""
    flag = lambda d, name: d.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    out = status.join(flag(edited, "edited"), key, "left").join(flag(keyed, "has_key"), key, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("edited", "has_key")})
    by = STATUS_SORTS.get(sort)
    by = F.col(by if by in out.columns else key)
    return out.orderBy(by.desc() if descending else by.asc(), F.col(key).asc())


def needs_attention(status: DataFrame, share: float = 0.3) -> DataFrame:
    """Documents without items or with answers for less than the share of them."""
    return status.where((F.col("items") == 0) | (F.col("answers") < share * F.col("items")))


def collection_summary(collections: DataFrame, items: DataFrame, files: DataFrame, slug: str, doc: str, recognized: Column) -> DataFrame:
    """(slug, docs, items, processed, unrecognized): processed leaves out documents whose name starts with _; unrecognized counts files."""
    by_doc = items.groupBy(slug, doc).agg(F.count("*").alias("n"))
    banks = by_doc.groupBy(slug).agg(F.count("*").alias("docs"), F.sum("n").alias("items"), F.count_if(~F.col(doc).startswith("_")).alias("processed"))
    odd = files.where(~recognized).groupBy(slug).agg(F.count("*").alias("unrecognized"))
    out = collections.select(slug).join(banks, slug, "left").join(odd, slug, "left")
    return out.select(slug, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "items", "processed", "unrecognized")])


def collection_page(summary: DataFrame, collections: DataFrame, files: DataFrame, slug: str, archived: str, is_source: Column, coach: bool, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, archived rows) that a viewer sees: collection_summary's rows of collections that are not archived, with files, the number of source files; a coach sees all, others
    those in allowed. Archived collections are listed for a coach only."""
    closed = F.coalesce(F.col(archived), F.lit(False))
    counts = files.where(is_source).groupBy(slug).agg(F.count("*").alias("files"))
    open_ = summary.join(collections.where(~closed).select(slug), slug, "left_semi")
    if not coach:
        open_ = open_.join(allowed.select(slug), slug, "left_semi")
    rows = open_.join(counts, slug, "left").withColumn("files", F.coalesce("files", F.lit(0)))
    return rows, collections.where(closed & F.lit(coach)).select(slug)


def topic_counts(items: DataFrame, topic: Column, taxonomy: list[str], other: str = "Other / General") -> DataFrame:
    """(topic_ord, topic, n) of every topic of the taxonomy, 0 included, and of other, which takes the unknown ones and comes last."""
    known = items.groupBy(F.when(topic.isin(*taxonomy), topic).otherwise(other).alias("topic")).agg(F.count("*").alias("n"))
    names = [*[t for t in taxonomy if t != other], other]
    listed = items.sparkSession.createDataFrame(list(enumerate(names)), "topic_ord int, topic string")
    return listed.join(known, "topic", "left").select("topic_ord", "topic", F.coalesce("n", F.lit(0)).alias("n"))


def nested_counts(items: DataFrame, focus: Column, topic: Column) -> DataFrame:
    """(focus, topic, n) with totals per focus and of all; a blank focus is (no focus)."""
    named = F.when(F.trim(F.coalesce(focus, F.lit(""))) == "", "(no focus)").otherwise(focus)
    return items.select(named.alias("focus"), topic.alias("topic")).rollup("focus", "topic").agg(F.count("*").alias("n"))


def usage_cost(usage: DataFrame, key: str, price_in: Column, price_out: Column) -> DataFrame:
    """(key, calls, input_tokens, output_tokens, cost): prices are per million tokens; the cost is rounded to four places."""
    cost = (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1_000_000
    return usage.groupBy(key).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 4).alias("cost"))


def estimate_cost(turns: DataFrame, key: str, text: Column, output_tokens: int, price_in: float, price_out: float) -> DataFrame:
    """(key, input_tokens, output_tokens, cost) of a conversation: a quarter of all its characters, one token at least, and an assumed output."""
    sums = turns.groupBy(key).agg(F.sum(F.length(F.coalesce(text, F.lit("")))).alias("chars"))
    tokens = F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).cast("long")
    return sums.select(key, tokens.alias("input_tokens"), F.lit(output_tokens).cast("long").alias("output_tokens"), F.round((tokens * price_in + output_tokens * price_out) / 1_000_000, 6).alias("cost"))


def focus_outline(items: DataFrame, focus: Column, topic: Column, foci: list[str], topics: list[str], other: str = "Other / General") -> DataFrame:
    """(focus_ord, focus, topic_ord, topic, n) of a collection's outline: foci as declared, items without one last under (no focus), topics as declared within each,
    unknown ones as other. Foci that are not declared are left out, and so are pairs without items."""
    order = lambda names: F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])
    named = [*topics, *[t for t in [other] if t not in topics]]
    rows = items.select(F.coalesce(F.nullif(focus, F.lit("")), F.lit("(no focus)")).alias("focus"), F.when(topic.isin(*topics), topic).otherwise(other).alias("topic"))
    counts = rows.groupBy("focus", "topic").agg(F.count("*").alias("n"))
    placed = counts.select(order([*foci, "(no focus)"])[F.col("focus")].alias("focus_ord"), "focus", order(named)[F.col("topic")].alias("topic_ord"), "topic", "n")
    return placed.where("focus_ord is not null")


def latest_jobs(feed: DataFrame, key: str, group: str, order: list[str], newest: str, most: int = 200) -> DataFrame:
    """The last state of each job, and of these the most newest of each group with their rank; the limit is the index's."""
    rest = [c for c in feed.columns if c not in (key, *order)]
    last = feed.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("s")).select(key, "s.*")
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(newest).desc(), F.col(key).desc()))).where(F.col("rank") <= most)


def active_jobs(jobs: DataFrame, group: str, active: Column, allowed: DataFrame) -> DataFrame:
    """(group, active): queued and running jobs of the groups that the viewer may open, 0 included."""
    counts = jobs.where(active).groupBy(group).agg(F.count("*").alias("active"))
    return allowed.select(group).distinct().join(counts, group, "left").select(group, F.coalesce("active", F.lit(0)).alias("active"))


def over_quota(jobs: DataFrame, group: str, active: Column, most: int = 8) -> DataFrame:
    """(group, active) of groups that have as many active jobs as they may, or more, and take no further one."""
    return jobs.where(active).groupBy(group).agg(F.count("*").alias("active")).where(F.col("active") >= most)


def interrupted(latest: DataFrame, running: Column, seen_at: Column, now: Column, seconds: int) -> DataFrame:
    """latest with interrupted: running, but not heard of for the seconds."""
    return latest.withColumn("interrupted", F.coalesce(running & (F.unix_micros(now) - F.unix_micros(seen_at.cast("timestamp")) > seconds * 1_000_000), F.lit(False)))


def import_report(judged: DataFrame, by: list[str], outcome: str, known: list[str]) -> DataFrame:
    """(by, a count of each known outcome, other): in one pass."""
    counts = [F.count_if(F.col(outcome) == o).alias(o) for o in known]
    return judged.groupBy(*by).agg(*counts, F.count_if(~F.coalesce(F.col(outcome).isin(*known), F.lit(False))).alias("other"))


def log_tail(lines: DataFrame, job: str, line_no: str, after: int) -> DataFrame:
    """The lines of each job after the given one."""
    return lines.where(F.col(line_no) > after)


def truncate_log(lines: DataFrame, job: str, line_no: str, line: str, most: int = 2000) -> DataFrame:
    """The last most lines of each job; a job that loses lines gets a marker row at the last lost number.

    Lines are numbered from 1 without gaps, so the last number tells what goes and nothing is sorted.
    """
    last = lines.groupBy(job).agg(F.max(line_no).alias("last"))
    kept = lines.join(last, job).where(F.col(line_no) > F.col("last") - most).select(job, line_no, line)
    cut = last.where(F.col("last") > most).select(job, (F.col("last") - most).alias(line_no), F.concat(F.lit("… "), (F.col("last") - most).cast("string"), F.lit(" earlier lines dropped")).alias(line))
    return kept.union(cut)


def sample_n(pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of the pool by a seeded hash of their key, the same on every run; all where there are fewer. The limit is the sample."""
    return pool.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def sample_groups(pool: DataFrame, full: DataFrame, group: str, key: str, n: int, seed: int, answered: Column | None = None) -> DataFrame:
    """(group, key) of whole groups of the pool in a seeded order until n items are reached: all where there are fewer, more where the last group passes n.

    A row without a group is a group of its own. A group has its members of the pool and, of full, its other members that are answered (all, by default); both count. keys are
    unique within a group. Sizes are summed up in two levels, so neither n nor the number of groups is bounded by a task.
    """
    solo = F.concat(F.lit("s"), F.col(key).cast("string"))
    name = lambda d: F.when(d[group].isNull(), solo).otherwise(F.concat(F.lit("g"), d[group].cast("string"))).alias("name")
    own = pool.select(name(pool), group, key)
    more = full.where((F.lit(True) if answered is None else answered) & F.col(group).isNotNull()).select(name(full), group, key)
    more = more.join(own.select("name").distinct(), "name", "left_semi").join(own.select("name", key), ["name", key], "left_anti").distinct()
    members = own.unionByName(more)
    sizes = members.groupBy("name").agg(F.count("*").alias("size")).withColumn("mixed", F.md5(F.concat_ws(":", F.lit(str(seed)), "name")))
    chosen = running_total(sizes, ["mixed", "name"], "size").where(F.col("before") < n).select("name")
    return members.join(chosen, "name", "left_semi").select(group, key)


def cluster_contexts(rows: DataFrame, order: str, context: Column) -> DataFrame:
    """rows with anchor, the least order of their context (their own without one), and within, the place in it; sorted by both, members of a context are together."""
    keyed = rows.withColumn("context", context)
    first = keyed.where("context is not null").groupBy("context").agg(F.min(order).alias("anchor"))
    out = keyed.join(first, "context", "left").withColumn("anchor", F.coalesce("anchor", order))
    return out.withColumn("within", F.when(F.col("context").isNull(), 1).otherwise(F.row_number().over(Window.partitionBy(F.coalesce(F.col("context").cast("string"), F.concat(F.lit("\x00"), F.col(order).cast("string")))).orderBy(order)))).drop("context")


def bank_order(topic_ord: str, year: str, number: str) -> list[Column]:
    """What a bank is sorted by: the topic's place, the latest year first with a blank one as 0, the number as text."""
    return [F.col(topic_ord), -F.coalesce(F.col(year).cast("string").try_cast("int"), F.lit(0)), F.col(number).cast("string")]


def assign_numbers(accepted: DataFrame, start: Column, slice_of: Column, order: list[str]) -> DataFrame:
    """accepted with number: start, start + 1, ... by order. slice_of must not fall along order: slices are numbered side by side and start where the
    slices before them end, which a row per slice tells."""
    keyed = accepted.withColumn("slice", slice_of)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("slice").agg(F.count("*").alias("n")).select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("slice").orderBy(*order))
    return keyed.withColumn("nth", nth).join(starts, "slice").withColumn("number", start + F.col("offset") + F.col("nth") - 1).drop("slice", "nth", "offset")


def canonical_item(options: Column, answers: Column, text_answers: Column) -> Column:
    """struct(choices, answer): an option's letter is its place among all options, empty ones too, which are then dropped; answer indices count
    the options that are left, outside ones are ignored; without options the first text answer stands."""
    lettered = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o, k: F.struct(F.chr(k + 65).alias("letter"), F.trim(o).alias("text")))
    choices = F.filter(lettered, lambda c: F.coalesce(c["text"], F.lit("")) != "")
    letters = F.transform(F.filter(F.coalesce(answers, F.array().cast("array<int>")), lambda a: (a >= 0) & (a < F.size(choices))), lambda a: F.element_at(choices, a + 1)["letter"])
    answer = F.when(F.size(choices) > 0, F.array_join(letters, ", ")).otherwise(F.coalesce(F.try_element_at(text_answers, F.lit(1)), F.lit("")))
    return F.struct(choices.alias("choices"), answer.alias("answer"))


def plain_key(name: Column, longest: int = 32) -> Column:
    """The name's letters and digits in lower case, s in front of a digit, student for none, cut to longest."""
    slug = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")
    return F.substring(F.when(slug == "", "student").when(slug.rlike("^[0-9]"), F.concat(F.lit("s"), slug)).otherwise(slug), 1, longest)


def unique_keys(rows: DataFrame, name: str, order: str, existing: DataFrame, key: str, longest: int = 32) -> DataFrame:
    """rows with username: the name's plain_key; the first free one of
    name, name2, name3, ... for each row by order. A numbered name takes no existing key and no other row's plain name. Numbers come from ranks in two levels, so a name that a third of all rows share
    is no task's alone. Where the numbers of two plain names make one name, as bo and bo1 can, the shorter plain name has it and the other goes on. Runs jobs when called."""
    based = rows.select(F.struct("*").alias("row"), F.col(order).alias("by"), plain_key(F.col(name), longest).alias("base"))
    # numbered names leave room for five digits where they would pass the limit
    based = based.withColumn("stem", F.when(F.length("base") > longest - 5, F.substring("base", 1, longest - 5)).otherwise(F.col("base")))
    taken = existing.select(F.col(key).alias("taken")).union(based.select("base")).distinct()
    free = based.groupBy("base").agg(F.min("by").alias("first")).join(existing.select(F.col(key).alias("base")).distinct(), "base", "left_anti")
    based = based.join(free, "base", "left").withColumn("own", F.coalesce(F.col("first") == F.col("by"), F.lit(False)))
    todo, done = based.where("not own").select("row", "stem", "by"), based.where("own").select("row.*", F.col("base").alias("username"))
    while True:
        named = _numbered(todo, taken).select("row", "stem", "by", F.concat("stem", F.col("number").cast("string")).alias("username"))
        # bo with 12 and bo1 with 2 are one name: possible only where a plain name ends in a digit, so there are rarely further rounds
        if not todo.where("stem rlike '[0-9]$'").limit(1).count():
            return done.union(named.select("row.*", "username"))
        named = written(named, "named")
        winner = named.groupBy("username").agg(F.min(F.struct(F.length("stem").alias("n"), "stem"))["stem"].alias("winner"))
        judged = named.join(winner, "username")
        kept = judged.where("stem = winner")
        done = done.union(kept.select("row.*", "username"))
        todo, taken = written(judged.where("stem <> winner").select("row", "stem", "by"), "todo"), taken.union(kept.select("username"))


def _numbered(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """rows (row, stem, by) with number, from 2: by order, each the next that no taken name has behind its stem."""
    digits = F.length(F.regexp_extract("taken", "[0-9]*$", 0))
    cuts = taken.where(digits > 0).select("taken", F.explode(F.sequence(F.lit(1), digits)).alias("d")).select(F.expr("left(taken, length(taken) - d)").alias("stem"), F.expr("right(taken, d)").alias("tail"))
    used = cuts.where("tail not like '0%' and length(tail) < 9").select("stem", F.col("tail").cast("long").alias("number")).where("number >= 2").distinct()
    used = used.join(rows.select("stem").distinct(), "stem", "left_semi")
    # before the i-th taken number, u, there are u - i - 1 free ones from 2 on; a row of rank k comes after all taken numbers with fewer than k, and so
    # its place among ranks and these counts, plus 1, is its number
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("row", "by")]
    gaps = ranked(used, ["stem"], ["number"], "i").select("stem", (F.col("number") - F.col("i") - 1).alias("pos"), F.lit(1).alias("gap"), *none)
    asked = ranked(rows, ["stem"], ["by"], "pos").select("stem", "pos", F.lit(0).alias("gap"), "row", "by")
    placed = ranked(asked.unionByName(gaps), ["stem"], ["pos", "gap"], "place").where("gap = 0")
    return placed.select("row", "stem", "by", (F.col("place") + 1).alias("number"))
