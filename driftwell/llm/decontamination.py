"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers (a whole literal with its sign, separators and decimals), names (capitalised words
within a sentence, also quoted; two or three in a row are one) and units after a number
become typed placeholders, so a question with other parameters keeps its template. All
windows of five tokens of all documents, as templates and as written, are hash-joined to
those of the benchmark. Along each alignment so found all windows of the item are compared:
one as written counts, one by placeholders if its run of matching tokens holds three literal
ones. The slots must be filled consistently: one value of the item goes with one value of
the document. A window that touches a slot of two values counts only as written. A document
leaks an item if it holds 0.8 of the item's windows or more, or 12 of them, a passage of
about 16 words.

Defined cases: null and empty texts, and items under five words, match nothing; items that
have five words but, with names of several words as one, under five tokens are read word by
word, as are all documents for them; template windows with fewer than three literal tokens
lead to no document, unless nearly all of the item's are such; rows of documents are told
apart by id and text, so null and repeated ids are judged each by their own text; rows
repeated whole give one pair; other columns are dropped by ``leaks``, kept by ``clean``;
empty tables give no pairs. Characters U+E000 to U+E006 in a text count as placeholders and
parts of numbers and names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, whole_row

WINDOW, SHARE, PASSAGE, LITERALS = 5, 0.8, 12, 3
#: Item windows up to which they are broadcast to the documents; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 500_000
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: What stands for the point, comma and sign of a number and for the blank within a name, as parts of one token.
POINT, COMMA, SIGN, JOIN = "\ue003", "\ue004", "\ue005", "\ue006"
#: Units that may follow a number.
UNITS = ("km", "kg", "cm", "mm", "m", "g", "mg", "lb", "lbs", "oz", "ft", "in", "mi", "mph", "s", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "years", "meters", "metres", "miles", "feet", "inches", "liters", "litres", "l", "ml", "usd", "eur", "dollars", "euros", "cents", "percent", "kw", "w", "v", "a", "hz", "mb", "gb")
_TOKEN = r"\p{L}\p{M}\p{N}" + NAME + NUMBER + UNIT + POINT + COMMA + SIGN + JOIN
_UNIT = "(?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"
_LITERAL = rf"{SIGN}?\p{{Nd}}+(?:[{POINT}{COMMA}]\p{{Nd}}+)*"
# A look at the first character comes before looks back, so that most places cost one test.
_DIGIT = rf"(?=[{SIGN}\p{{Nd}}])(?<![{_TOKEN}])"
_OPEN = "[\"'(\\[\u00ab\u2018\u201a\u201c\u201e]"
_CAPITAL = r"\p{Lu}\p{Ll}[\p{L}\p{M}]*"


def _with(df: DataFrame, **cols: Column) -> DataFrame:
    """df with columns that are computed once, not again wherever another expression names them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def _whole(rows: DataFrame, names: bool) -> DataFrame:
    """rows with text (null: empty) in which each number is one token, a blank stands before a unit written onto a number,
    and, for names, names of two or three words are one token."""
    text = F.col("clear")
    for pattern, by in ((r"\.(?<=\p{Nd}.)(?=\p{Nd})", POINT), (r",(?<=\p{Nd}.)(?=\p{Nd}{3}(?!\p{Nd}))", COMMA), (rf"[-\u2212](?<![{_TOKEN})\]].)(?=\p{{Nd}})", SIGN), (rf"{_DIGIT}({_LITERAL})(?={_UNIT}(?![{_TOKEN}]))", "$1 ")):
        text = F.regexp_replace(text, pattern, by)
    rows = rows.withColumn("clear", F.coalesce("text", F.lit(""))).drop("text")
    rows = _with(rows, **{"text" if not names else "numbers": F.when(F.col("clear").rlike(r"\p{Nd}"), text).otherwise(F.col("clear"))}).drop("clear")
    if not names:
        return rows
    word = rf"(?<![{_TOKEN}]){_CAPITAL}(?![{_TOKEN}])"
    # Runs of exactly two or three; longer ones are titles, and each of their words stands for itself.
    run = rf"(?=\p{{Lu}}\p{{Ll}})(?<!\p{{Lu}}[\p{{L}}\p{{M}}]{{1,30}}\s)({word})\s({word})(?:\s({word}))?(?!\s{_CAPITAL}(?![{_TOKEN}]))"
    joined = F.regexp_replace(F.regexp_replace("numbers", run, f"$1{JOIN}$2{JOIN}$3"), rf"{JOIN}(?![{_TOKEN}])", "")
    return _with(rows, text=F.when(F.col("numbers").rlike(rf"{_CAPITAL}\s\p{{Lu}}"), joined).otherwise(F.col("numbers"))).drop("numbers")


def _template(text: Column, names: bool = True) -> Column:
    capital = rf"\p{{Lu}}\p{{Ll}}[{_TOKEN}]*"
    within = rf"(?=\p{{Lu}}\p{{Ll}})(?:(?<=[\p{{Ll}}\p{{Nd}},;:/\p{{Pd}}]\s{_OPEN}?)|(?<={_OPEN}|[/\p{{Pd}}])){capital}"
    # A joined name, with what its capital letter needs no look back for, or a capital where a name can stand.
    named = F.regexp_replace(text, rf"(?=\p{{Lu}}\p{{Ll}})(?:{_CAPITAL}{JOIN}[{_TOKEN}]*|{within})", NAME) if names else text
    numbers = F.regexp_replace(named, rf"{_DIGIT}{_LITERAL}(?![{_TOKEN}])", NUMBER)
    units = F.regexp_replace(numbers, rf"({NUMBER}\s){_UNIT}(?![{_TOKEN}])", f"$1{UNIT}")
    return F.lower(F.when(text.rlike(r"\p{Nd}"), units).otherwise(named))


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[^{_TOKEN}]+", -1), "")


def templates(rows: DataFrame, *keep: str, names: bool = True) -> DataFrame:
    """keep, raw (tokens as written, lower-cased), tokens (template tokens) and plain (the same with names as they are), in the same places.
    names: whether names of several words are one token."""
    return _whole(rows.select(*keep, "text"), names).select(*keep, _tokens(F.lower("text")).alias("raw"), _tokens(_template(F.col("text"))).alias("tokens"), _tokens(_template(F.col("text"), False)).alias("plain"))


def _windows(tokens: Column) -> Column:
    hash_at = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(WINDOW)])
    return F.when(F.size(tokens) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(tokens) - WINDOW), hash_at))


def _literals(tokens: Column, at: Column) -> Column:
    return F.size(F.filter(F.slice(tokens, at + 1, WINDOW), lambda t: ~t.isin(NAME, NUMBER, UNIT)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, at, item_id, n_hit, n_windows, share, n_slots, reparameterised) of documents (doc_id, text) and items
    (item_id, text). at: hash of the document's text. reparameterised: whether a slot holds another value than the item's."""
    size = lambda names: _whole(benchmark.select("item_id", "text"), names).select("item_id", F.size(_tokens(F.col("text"))).alias("n"))
    few = size(True).where(F.col("n") < WINDOW).join(size(False).where(F.col("n") >= WINDOW), "item_id", "left_semi").select("item_id").distinct()
    found = _leaks(docs, benchmark, True)
    if few.isEmpty():
        return found
    # Written before they meet: the planner of a union may not compare the partitionings of so different plans.
    return cut(found).unionByName(cut(_leaks(docs, cut(benchmark.join(few, "item_id", "left_semi")), False)))


def _leaks(docs: DataFrame, benchmark: DataFrame, names: bool) -> DataFrame:
    at = F.xxhash64("text").alias("at")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), at, "text")
    items = templates(benchmark, "item_id", names=names).withColumnsRenamed({"raw": "item_raw", "tokens": "item_tokens"})
    # A text in one case shows no names: items are looked for in both forms. As written, all windows count as they are.
    form = lambda c: items.select("item_id", F.col(c).alias("form")).select("item_id", "form", F.posexplode(_windows(F.col("form"))).alias("ipos", "h"))
    windows = form("item_tokens").unionByName(form("plain")).withColumn("n_literal", _literals(F.col("form"), F.col("ipos"))).drop("form")
    rich = windows.groupBy("item_id", "ipos").agg(F.max(F.col("n_literal") >= LITERALS).alias("rich"))
    sizes = rich.groupBy("item_id").agg(F.count("*").alias("n_windows"), F.count_if(~F.col("rich")).alias("n_poor"))
    # Of an item that can leak without one window of enough literals, the poorer windows lead to documents as well.
    bare = F.col("n_windows") - F.col("n_poor") <= F.col("n_windows") * (1 - SHARE)
    own = windows.join(sizes, "item_id").where((F.col("n_literal") >= LITERALS) | bare & (F.col("n_literal") >= 1))
    own = own.select("item_id", "ipos", "h").unionByName(form("item_raw").select("item_id", "ipos", "h")).distinct()
    items = items.drop("plain")
    few = own.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    small = F.broadcast if few else (lambda df: df)
    # Windows as written are added only where they differ from those of the template, around a placeholder.
    # Tokens are fixed before the filter: pushed below a projection it would compute them a second time.
    read = _with(_whole(rows, names), raw=_tokens(F.lower("text")), tokens=_tokens(_template(F.col("text")))).select("doc_id", "at", "raw", "tokens").where(F.size("tokens") >= WINDOW)
    read = _with(read, last=F.size("tokens") - WINDOW)
    other = F.array_compact(F.transform(F.zip_with("tokens", "raw", lambda a, b: a != b), lambda differs, j: F.when(differs, j)))
    read = _with(read, other=other)
    around = F.array_distinct(F.flatten(F.transform("other", lambda j: F.sequence(F.greatest(j - (WINDOW - 1), F.lit(0)), F.least(j, F.col("last"))))))
    window = lambda tokens, i: F.struct(i.alias("dpos"), F.xxhash64(*[F.get(tokens, i + j) for j in range(WINDOW)]).alias("h"))
    placed = F.concat(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: window(F.col("tokens"), i)), F.transform(around, lambda i: window(F.col("raw"), i)))
    found = read.select("doc_id", "at", F.inline(placed))
    met = found.join(small(own), "h").select("doc_id", "at", "item_id", "ipos", "dpos")
    enough = lambda n: (n >= F.col("n_windows") * SHARE) | (n >= PASSAGE)
    pairs = met.groupBy("doc_id", "at", "item_id").agg(F.collect_set(F.struct("ipos", "dpos")).alias("met"))
    n_items = lambda met: F.size(F.array_distinct(F.transform(met, lambda p: p["ipos"])))
    # Windows poor in literals are looked at along the alignments only, so any of them may come on top.
    pairs = pairs.join(small(sizes), "item_id").where(enough(n_items(F.col("met")) + F.col("n_poor"))).drop("n_poor")
    # Slots are read for the few pairs that are left: the documents come by a hash join whose built side these are.
    # Rows repeated whole would come twice, hence distinct after the arrays are gone.
    pairs = pairs.withColumn("null_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    keyed = rows.select(F.col("doc_id").isNull().alias("null_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "at", "text")
    lines = F.array_distinct(F.transform("met", lambda p: p["dpos"] - p["ipos"])).alias("lines")
    pairs = pairs.select("doc_id", "null_id", "at", "item_id", "n_windows", lines)
    with_text = keyed.join(pairs.hint("shuffle_hash"), ["doc_id", "null_id", "at"]).join(small(items), "item_id")
    read = _whole(with_text, names).withColumns({"raw": _tokens(F.lower("text")), "tokens": _tokens(_template(F.col("text")))}).drop("text")
    # Of each alignment the document's tokens beside the item's are cut out before the rows are multiplied.
    read = _with(read, strips=F.transform("lines", lambda k: F.struct(
        k.alias("line"),
        F.slice("raw", F.greatest(k, F.lit(0)) + 1, F.greatest(F.size("item_tokens") + F.least(k, F.lit(0)), F.lit(0))).alias("raw"),
        F.slice("tokens", F.greatest(k, F.lit(0)) + 1, F.greatest(F.size("item_tokens") + F.least(k, F.lit(0)), F.lit(0))).alias("tokens"),
    )))
    lines = read.select("doc_id", "null_id", "at", "item_id", "n_windows", "item_raw", "item_tokens", F.explode("strips").alias("strip"))
    # The item's tokens along the alignment: whether the document has them as written (same), and where they match at least as placeholders.
    beside = lambda c, i: F.when(i + F.least(F.col("strip.line"), F.lit(0)) >= 0, F.get(F.col(f"strip.{c}"), i + F.least(F.col("strip.line"), F.lit(0))))
    lines = _with(lines, pairs=F.transform(F.sequence(F.lit(0), F.size("item_tokens") - 1), lambda i: F.struct(F.get(F.col("item_tokens"), i).alias("kind"), F.get(F.col("item_raw"), i).alias("item"), beside("raw", i).alias("doc"), beside("tokens", i).alias("doc_kind"))))
    lines = lines.select("doc_id", "null_id", "at", "item_id", "n_windows", F.col("strip.line").alias("line"), "pairs")
    lines = _with(lines, along=F.transform("pairs", lambda t: F.struct(t["kind"].alias("kind"), t["item"].alias("item"), t["doc"].alias("doc"), F.coalesce(t["item"] == t["doc"], F.lit(False)).alias("same"), F.coalesce((t["item"] == t["doc"]) | (t["kind"] == t["doc_kind"]), F.lit(False)).alias("fits")))).drop("pairs")
    each = F.sequence(F.lit(0), F.size("along") - 1)
    token = lambda i: F.get(F.col("along"), i)
    lines = _with(lines, breaks=F.filter(each, lambda i: ~token(i)["fits"]), literal=F.filter(each, lambda i: token(i)["same"] & ~token(i)["kind"].isin(NUMBER, UNIT)), changed=F.filter(each, lambda i: ~token(i)["same"]))
    none = lambda places, i: ~F.exists(places, lambda j: (j >= i) & (j < i + WINDOW))
    lines = _with(lines, fit=F.filter(F.sequence(F.lit(0), F.size("along") - WINDOW), lambda i: none("breaks", i))).where(F.size("fit") > 0)
    # A run of matching tokens needs as many literal ones as a window did; windows as written need none.
    between = lambda i, j: ~F.exists("breaks", lambda k: (k > F.least(i, j)) & (k < F.greatest(i, j)))
    run = lambda i: F.size(F.filter("literal", lambda j: between(i, j))) >= LITERALS
    lines = _with(lines, on=F.filter("fit", lambda i: none("changed", i) | run(i))).where(F.size("on") > 0)
    # All slots from the first to the last window of the alignment, also those between windows that count.
    places = F.sequence(F.array_min("on"), F.array_max("on") + (WINDOW - 1))
    places = F.filter(places, lambda i: token(i)["fits"] & token(i)["kind"].isin(NAME, NUMBER, UNIT))
    slot = lambda i: F.struct(token(i)["kind"].alias("kind"), token(i)["item"].alias("item"), token(i)["doc"].alias("doc"))
    lines = _with(lines, slots=F.array_distinct(F.transform(places, slot)))
    # Two values of one item value make its slots odd: windows that touch one count only as written.
    odd = lambda i: token(i)["fits"] & F.exists("slots", lambda s: (s["kind"] == token(i)["kind"]) & (s["item"] == token(i)["item"]) & (s["doc"] != token(i)["doc"]))
    lines = _with(lines, odd=F.filter(each, odd))
    lines = _with(lines, kept=F.filter("on", lambda i: none("changed", i) | none("odd", i))).drop("on").withColumnRenamed("kept", "on").where(F.size("on") > 0)
    other = F.exists("slots", lambda s: s["item"] != s["doc"])
    lines = lines.select("doc_id", "null_id", "at", "item_id", "n_windows", "line", "on", F.size("slots").alias("n"), other.alias("other")).distinct()
    out = lines.groupBy("doc_id", "null_id", "at", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("on")))).alias("n_hit"), F.sum("n").alias("n_slots"), F.bool_or("other").alias("reparameterised"))
    doc_id = F.when(~F.col("null_id"), F.col("doc_id")).alias("doc_id")
    return out.where(enough(F.col("n_hit"))).select(doc_id, "at", "item_id", F.col("n_hit").cast("long").alias("n_hit"), "n_windows", (F.col("n_hit") / F.col("n_windows")).alias("share"), "n_slots", "reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item, all columns as they are."""
    gone = leaks(docs, benchmark).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "at").distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("at"), whole_row(docs))
    return rows.join(gone.hint("shuffle_hash"), ["id", "none", "at"], "left_anti").select("row.*")
