"""Personal data and the terms that disclose it (operator 2), DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  The
corpus then tells which other terms reveal such an entity.  Every document that
holds an entity e offers its names and identifiers as candidates, wherever they
stand in it: words written with a capital, words of scripts without capitals, and
words with letters and digits.  For a candidate t, over documents,

    PMI(t; e) = log(P(t, e) / (P(t) P(e))),   IC(e) = -log P(e),

so that PMI / IC is 1 if t never occurs without e.  P(e | t) is known from few
documents only, so t discloses e if the ratio reaches ``threshold`` with the lower
confidence bound (Wilson) of P(e | t) in place of its estimate.  The term must
occur in ``support`` different texts that hold e and in ``COVERAGE`` of them (copies
of one text prove nothing).  Where more than ``OWN_WORDS`` words of any kind qualify for
one entity, its documents may hold copies of one passage, whose words are not the
entity's own: each of its terms is then looked up where it stands, and those that keep
the same ``BESIDE`` words before or behind them in ``COVERAGE`` of the texts are left out.
An ordinary word is no candidate, or occurs without e.

A disclosing term is a ``term`` span wherever it occurs, in any case, in a document
that holds the entity.  An entity in a single text has no terms: nothing there
tells a name from a word.

Positions are code points.  Where a match begins comes from the lengths of the
pieces between matches (``split``) and of the matches (``regexp_extract_all``).
The patterns are written so that matching takes linear time on any text:
possessive repeats, and starts only where the leftmost match can start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 2                 # different texts that must hold the entity and the term
COVERAGE = 0.5              # part of the entity's texts that must hold the term
OWN_WORDS = 8               # words that go with one entity only; with more, copied passages are looked for
BESIDE = 4                  # words before or behind a term that make a copied passage
THRESHOLD = 0.8
CONFIDENCE = 1.645          # of the lower bound, in standard deviations (95 % one-sided)
BROADCAST_BYTES = 32 << 20  # of a table sent to every executor; its size is measured first, a larger one is shuffled

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # an address starts where its run of characters does, or right after the address before
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_LETTER = r"[\p{L}\p{M}\p{N}]"
_WORD = _LETTER + "{2,}"
_NAMED = r"\A\p{Lu}|\A\p{Lt}|\p{Lo}|\p{N}.*\p{L}|\p{L}.*\p{N}"   # a capital, a letter without case, letters and digits


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        return F.length(_digits(hit)).between(13, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _value(kind: str, hit: Column) -> Column:
    """What makes two matches the same entity."""
    if kind == "email":
        return F.lower(hit)
    return hit if kind == "ip" else _digits(hit)


def _matches(df: DataFrame, text: str, name: str, pattern: Column, needed: Column) -> DataFrame:
    """Adds ``_g_name`` (pieces between matches) and ``_m_name`` (matches) where ``needed``."""
    none = F.array().cast("array<string>")
    return df.withColumns({f"_g_{name}": F.when(needed, F.split(F.col(text), pattern, -1)).otherwise(none),
                           f"_m_{name}": F.when(needed, F.regexp_extract_all(F.col(text), pattern, F.lit(0))).otherwise(none)})


def _spans(name: str, valid) -> Column:
    """``array<struct<start, end>>`` of the valid matches, from their columns."""
    pairs = F.zip_with(f"_g_{name}", f"_m_{name}", lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("hit")))
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(a, p):
        start = a["at"] + p["gap"]
        end = start + F.coalesce(F.length(p["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        ok = F.coalesce(p["hit"].isNotNull() & valid(p["hit"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(ok, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(pairs, start, step)["out"]


def base_matches(docs: DataFrame, text: str) -> DataFrame:
    for kind in KINDS:
        docs = _matches(docs, text, kind, F.lit(PATTERNS[kind]), F.col(text).rlike(_NEEDS[kind]))
    return docs


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``email, ip, card, phone``: the spans of each kind (``text`` not null)."""
    found = base_matches(docs, text)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    return found.select(*keep, *[_spans(k, lambda h, k=k: _valid(k, h)).alias(k) for k in KINDS])


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df``, to be broadcast if its rows take ``BROADCAST_BYTES`` together at most."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def entities(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(key, kind, value)``: every valid base match, once per row and value."""
    rows = None
    found = base_matches(docs.select(key, text), text)
    for kind in KINDS:
        one = (found.select(key, F.explode(f"_m_{kind}").alias("hit")).where(_valid(kind, F.col("hit")))
               .select(key, F.lit(kind).alias("kind"), _value(kind, F.col("hit")).alias("value")))
        rows = one if rows is None else rows.union(one)
    return rows.distinct()


def _words(text: Column) -> Column:
    """``array<struct<term, named>>``: the distinct words of a text, base matches left out; ``term`` is in
    lower case, ``named`` tells a name or an identifier."""
    for kind in KINDS:
        text = F.when(text.rlike(_NEEDS[kind]), F.regexp_replace(text, PATTERNS[kind], " ")).otherwise(text)
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))
    return F.array_distinct(F.transform(words, lambda w: F.struct(F.lower(w).alias("term"), w.rlike(_NAMED).alias("named"))))


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str, key: str, support: int = SUPPORT,
                     threshold: float = THRESHOLD) -> DataFrame:
    """``(kind, value, term, disclosure, sure)`` of the terms that reveal an entity.

    ``found`` are the entities of ``docs``; ``key`` is one number per row, equal for equal
    rows.  ``disclosure`` is PMI / IC, ``sure`` its value at the lower bound of P(e | t).  Document
    frequencies are taken over all rows of ``docs``."""
    n = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]  # one number
    held = found.groupBy(key).agg(F.collect_set(F.struct("kind", "value")).alias("of"))   # a text's own entities
    rows = docs.join(_small(held, 24 + 48 * F.size("of")), key).select(F.xxhash64(text).alias("_text"), text, "of")
    each = F.struct(F.count(F.lit(1)).alias("rows"), F.count_distinct("_text").alias("texts"))
    own = (rows.select("_text", F.inline("of")).groupBy("kind", "value").agg(each.alias("e"))
           .where(F.col("e.texts") >= support))
    own = written(own.select("kind", "value", F.col("e.rows").alias("of_entity"), F.col("e.texts").alias("texts")), "entities-own")
    # only entities of several texts can have terms: the others' documents are not looked at
    some = _small(own.select("kind", "value"), 24 + F.length("value"))
    shared = rows.select("_text", text, F.inline("of")).join(some, ["kind", "value"], "left_semi")
    both = (shared.select("_text", "kind", "value", F.inline(_words(F.col(text))))
            .groupBy("kind", "value", "term", "_text", "named").agg(F.count(F.lit(1)).alias("_c"))   # rows of the text
            .groupBy("kind", "value", "term", "_text").agg(F.max("_c").alias("_c"), F.max("named").alias("named"))
            .groupBy("kind", "value", "term").agg(F.struct(F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("texts")).alias("b"),
                                                  F.max("named").alias("named")))
    pairs = written(both.join(own, ["kind", "value"])
                    .where((F.col("b.texts") >= support) & (F.col("b.texts") >= COVERAGE * F.col("texts")))
                    .select("kind", "value", "term", "named", "of_entity", F.col("b.rows").alias("both")), "pairs")
    terms = _small(pairs.select("term").distinct(), 16 + F.length("term"))
    everywhere = (docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))).alias("term"))
                  .join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("of_term")))
    ic = F.log(F.lit(float(n)) / F.col("of_entity"))
    share = F.col("both") / F.greatest("of_term", "both")
    z2 = CONFIDENCE ** 2
    lower = ((share + z2 / (2 * F.col("of_term")) - CONFIDENCE * F.sqrt(share * (1 - share) / F.col("of_term") + z2 / (4 * F.col("of_term") ** 2)))
             / (1 + z2 / F.col("of_term")))

    def ratio(p):
        return F.when(ic > 0, F.log(p * F.lit(float(n)) / F.col("of_entity")) / ic).otherwise(0.0)

    sure = (pairs.join(everywhere, "term").select("kind", "value", "term", "named", ratio(share).alias("disclosure"), ratio(lower).alias("sure"))
            .where(F.col("sure") >= threshold))
    own_words = F.count_if(F.col("sure") >= max(threshold, THRESHOLD))
    sure = written(sure, "sure")
    many = sure.groupBy("kind", "value").agg(own_words.alias("_n")).where(F.col("_n") > OWN_WORDS).drop("_n")
    many = _small(many, 24 + F.length("value"))
    named = sure.where("named").drop("named")
    asked = named.join(many, ["kind", "value"], "left_semi").select("kind", "value", "term")
    return named.join(_copied(shared, asked, own, text), ["kind", "value", "term"], "left_anti")


def _copied(shared: DataFrame, asked: DataFrame, own: DataFrame, text: str) -> DataFrame:
    """``(kind, value, term)`` of the ``asked`` that stand in a passage copied between the entity's texts.

    ``shared`` has a row ``(_text, text, kind, value)`` for each document and entity in it."""
    entity = _small(asked.select("kind", "value").distinct(), 24 + F.length("value"))
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    texts = (shared.join(entity, ["kind", "value"], "left_semi").groupBy("kind", "value", "_text")
             .agg(F.first(text).alias(text)).select("kind", "value", "_text", words.alias("_w")))
    places = texts.select("kind", "value", "_text", "_w", F.posexplode("_w").alias("_i", "term"))
    before = F.when(F.col("_i") >= BESIDE, F.xxhash64(F.lit(0), F.slice("_w", F.col("_i") - BESIDE + 1, BESIDE)))
    behind = F.when(F.col("_i") + BESIDE < F.size("_w"), F.xxhash64(F.lit(1), F.slice("_w", F.col("_i") + 2, BESIDE)))
    sides = (places.join(asked, ["kind", "value", "term"], "left_semi")
             .select("kind", "value", "term", "_text", F.explode(F.array_compact(F.array(before, behind))).alias("_side")))
    return (sides.groupBy("kind", "value", "term", "_side").agg(F.count_distinct("_text").alias("_n"))
            .join(own.select("kind", "value", "texts"), ["kind", "value"])
            .where((F.col("_n") >= SUPPORT) & (F.col("_n") >= COVERAGE * F.col("texts"))).select("kind", "value", "term").distinct())


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Row content as the key: rows alike in id and text have the same spans."""
    return docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_k", F.xxhash64(key, "_t"))


def with_terms(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``_terms``: the disclosing terms of each row, or null.

    ``docs`` has ``_key`` and ``_t`` (text, null as empty); rows alike in both have the same terms."""
    rows = _keyed(docs, "_key", "_t")
    lean = rows.select("_k", "_t")
    found = written(entities(lean.where(F.col("_t").rlike("[0-9@]")), "_t", "_k"), "entities")
    flagged = written(disclosing_terms(lean, found, "_t", "_k", support, threshold), "disclosing")
    per_row = written(found.join(_small(flagged, 48 + F.length("value")), ["kind", "value"])
                      .groupBy("_k").agg(F.sort_array(F.collect_set("term")).alias("_terms")), "flagged")
    return rows.join(_small(per_row, 24 + 24 * F.size("_terms")), "_k", "left").drop("_k")


def _term_pattern() -> Column:
    return F.concat(F.lit(rf"(?iu)(?<!{_LETTER})(?:"), F.array_join("_terms", "|"), F.lit(rf")(?!{_LETTER})"))


def sensitive_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT,
                    threshold: float = THRESHOLD) -> DataFrame:
    """``(key, email, ip, card, phone, term)``: spans of every row's whole text.

    Null text is empty, an empty text has no spans; repeated rows and rows of one or no
    key each have their own.  A term span that touches a base span is left out."""
    names = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = with_spans(with_terms(names, support, threshold), "_t")
    rows = _matches(rows, "_t", "term", F.coalesce(_term_pattern(), F.lit("$")), F.col("_terms").isNotNull())
    base = F.concat(*KINDS)
    term = F.filter(F.col("_term"), lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return (rows.withColumn("_term", _spans("term", lambda h: F.lit(True))).withColumn("_base", base)
            .select(F.col("_key").alias(key), *KINDS, term.alias("term")))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT,
              threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base matches replaced by their kind and disclosing terms by ``[TERM]``; null stays
    null.  Columns keep their names and values, whatever they are called; no row is added or lost."""
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = rows.withColumns({"_key": F.col(names[key]), "_t": F.coalesce(F.col(names[text]), F.lit(""))})
    rows = with_terms(rows, support, threshold)
    for kind in KINDS:
        def put(g, m):
            mark = F.when(m.isNotNull() & _valid(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m)  # noqa: B023 - used at once
            return F.concat(g, F.coalesce(mark, F.lit("")))

        rows = _matches(rows, "_t", kind, F.lit(PATTERNS[kind]), F.col("_t").rlike(_NEEDS[kind]))
        pieces = F.zip_with(f"_g_{kind}", f"_m_{kind}", put)
        rows = (rows.withColumn("_t", F.when(F.size(f"_m_{kind}") > 0, F.array_join(pieces, "")).otherwise(F.col("_t")))
                .drop(f"_g_{kind}", f"_m_{kind}"))
    cleaned = F.when(F.col("_terms").isNotNull(), F.regexp_replace("_t", _term_pattern(), F.lit("[TERM]"))).otherwise(F.col("_t"))
    return rows.select(*[(F.when(F.col(n).isNotNull(), cleaned) if c == text else F.col(n)).alias(c) for c, n in names.items()])


def _listed(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and disclosing spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = sensitive_spans(docs)
    base = F.array_join(F.concat(*[_listed(k) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[_listed(k) for k in (*KINDS, "term")]), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"),
                        F.size("term").cast("long").alias("n_term"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its personal data replaced."""
    return sanitised(docs)
