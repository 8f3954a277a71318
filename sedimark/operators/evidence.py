"""Grounding of claims, issuer names, evidence ids and citations."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sedimark.functions.numbers import is_period
from sedimark.functions.text import nfkc

#: Dashes and quotes that count as one, and what they become.
_FOLDED, _PLAIN = "–—−‐‑“”‘’「」『』", "-----\"\"''\"\"\"\""


def compact(text: Column) -> Column:
    """NFKC, lower case, no white space, dashes and quotes folded: the form in which quotes are compared."""
    whole = nfkc(text)
    folded = F.when(whole.rlike(f"[{_FOLDED}]"), F.translate(whole, _FOLDED, _PLAIN)).otherwise(whole)
    return F.regexp_replace(F.lower(folded), r"\s+", "")


def quoted(text: Column, quote: Column, least: int = 6) -> Column:
    """Whether a quote of least characters or more stands in a text."""
    q = compact(quote)
    return F.coalesce((F.length(q) >= least) & F.contains(compact(text), q), F.lit(False))


def numbers_in(text: Column) -> Column:
    """The numbers of a text; bracketed ones are negative."""
    found = F.regexp_extract_all(text, F.lit(r"(\(\s*\d[\d,]*(?:\.\d+)?\s*\)|(?<![\w.])-?\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\(\s*", "-"), r"[,)\s]", "").try_cast("double"))
    return F.filter(plain, lambda x: x.isNotNull())


def number_quoted(value: Column, text: Column, tolerance: float = 1e-10) -> Column:
    """Whether value is one of a text's numbers, as a whole number and not as part of one."""
    return F.exists(numbers_in(text), lambda x: F.abs(x - value) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(x), F.abs(value))))


def deduplicated_claims(claims: DataFrame, keys: list[str], confidence: str, evidence: str, quotes: str, most_quotes: int = 6) -> DataFrame:
    """One claim of each key, the most confident; evidence ids and the first quotes of all of them."""
    others = [c for c in claims.columns if c not in (*keys, evidence, quotes)]
    out = claims.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(confidence, *[o for o in others if o != confidence])).alias("_c"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias(evidence), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(quotes)))), 1, most_quotes).alias(quotes),
    )
    return out.select(*keys, *[F.col(f"_c.{o}").alias(o) for o in others], evidence, quotes)


def issuer_key(name: Column) -> Column:
    """A name's core: lower case, without punctuation and legal suffixes."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"[\s\p{Punct}（）·]+", "")
    core = F.regexp_replace(bare, r"(股份有限公司|有限责任公司|有限公司|控股|集团|证券|incorporated|limited|company|corp|inc|ltd|llc|plc)+$", "")
    return F.when(core == "", bare).otherwise(core)


def resolved_issuers(mentions: DataFrame, registry: DataFrame, name: str, slack: int = 6) -> DataFrame:
    """mentions with issuer_key: by a registered name or alias, else by one that the name starts with.

    registry has issuer_key, issuer_name and aliases. Names are compared by their
    core; a prefix match allows slack more characters and takes the longest. Both
    steps are equal joins: a mention lists its own prefixes.
    """
    known = registry.select("issuer_key", F.explode(F.concat(F.array("issuer_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_alias"))
    known = known.select(issuer_key(F.col("_alias")).alias("_core"), "issuer_key").filter("_core <> ''").groupBy("_core").agg(F.min("issuer_key").alias("issuer_key"))
    cored = mentions.withColumn("_name_core", issuer_key(F.col(name)))
    names = cored.select("_name_core").distinct()
    size = F.length("_name_core")
    prefixes = names.filter(size > 0).select("_name_core", F.explode(F.transform(F.sequence(F.greatest(F.lit(1), size - slack), size), lambda n: F.substr("_name_core", F.lit(1), n))).alias("_core"))
    best = prefixes.join(known, "_core").groupBy("_name_core").agg(F.max_by("issuer_key", F.length("_core")).alias("issuer_key"))
    return cored.join(best, "_name_core", "left").drop("_name_core")


#: What a name weighs in the file name, and each time and at most at the head, at the tail and anywhere in the text that is looked at.
IN_FILE_NAME, AT_AN_END, IN_TEXT = 0.60, (0.17, 0.34), (0.02, 0.10)


def issuer_scores(docs: DataFrame, aliases: DataFrame, head: int = 1800, body: int = 12_000, most: int = 5, most_aliases: int = 1_000_000) -> DataFrame:
    """The best issuers (issuer_key, score, place) of each document (doc_id, filename, text) by where their aliases (issuer_key, alias) occur.

    By rule the first body characters of a text are looked at; their first and last head
    characters are the head and the tail, which a text no longer than the head doesn't
    have. Texts and aliases are compared in NFKC and lower case, occurrences of one alias
    don't overlap, aliases of one character are passed over, an issuer scores by its best alias
    and the most best issuers are given (ties: by key). A null text or file name is empty.

    Each task looks for all aliases at once, by an automaton whose size is that of the aliases;
    more than most_aliases of them are refused.
    """
    form = lambda v: unicodedata.normalize("NFKC", v or "").lower()
    listed = aliases.select("issuer_key", "alias").filter("issuer_key IS NOT NULL AND length(alias) > 0").distinct().limit(most_aliases + 1).collect()
    if len(listed) > most_aliases:
        raise ValueError(f"more than {most_aliases} aliases")
    owners: dict[str, set] = {}
    for row in listed:
        if len(form(row["alias"])) >= 2:
            owners.setdefault(form(row["alias"]), set()).add(row["issuer_key"])
    named = docs.sparkSession.sparkContext.broadcast(owners)

    def counted(finder, text: str) -> dict[str, int]:
        ends, counts = {}, {}
        for last, alias in finder.iter(text):
            if last - len(alias) >= ends.get(alias, -1):
                ends[alias], counts[alias] = last, counts.get(alias, 0) + 1
        return counts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for alias in named.value:
            finder.add_word(alias, alias)
        finder.make_automaton()
        for batch in batches:
            rows = []
            for k, (name, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not named.value:
                    continue
                shown = form(text)[:body]
                in_name, in_text = counted(finder, form(name)), counted(finder, shown)
                ends = [counted(finder, shown[:head]), counted(finder, shown[-head:] if len(shown) > head else "")]
                best: dict = {}
                for alias in in_name.keys() | in_text.keys():
                    score = IN_FILE_NAME * (alias in in_name) + sum(min(AT_AN_END[1], AT_AN_END[0] * e.get(alias, 0)) for e in ends) + min(IN_TEXT[1], IN_TEXT[0] * in_text.get(alias, 0))
                    for key in named.value[alias]:
                        best[key] = max(best.get(key, 0.0), round(min(1.0, score), 4))
                ranked = sorted(best.items(), key=lambda x: (-x[1], str(x[0])))[:most]
                rows += [(k, key, score, place) for place, (key, score) in enumerate(ranked, 1)]
            if rows:
                at, key, score, place = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(key, key_type), pa.array(score, pa.float64()), pa.array(place, pa.int32())], ["doc_id", "issuer_key", "score", "place"])

    shape = StructType([docs.schema["doc_id"], aliases.schema["issuer_key"], *StructType.fromDDL("score double, place int").fields])
    key_type = to_arrow_schema(shape).field("issuer_key").type
    return docs.select("doc_id", "filename", "text").mapInArrow(work, shape)


def located(evidence: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """Evidence ids such as page:12 with the location of the row that they name.

    kinds has a table of (key, location) for each prefix; ids of unknown kinds or
    rows get a null location.
    """
    split = evidence.withColumns({"_kind": F.substring_index("evidence_id", ":", 1), "_key": F.regexp_replace("evidence_id", r"^[^:]*:", "")})
    tables = [df.select(F.lit(kind).alias("_kind"), F.col("key").cast("string").alias("_key"), F.col("location").cast("string").alias("location")) for kind, df in kinds.items()]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return split.join(every, ["_kind", "_key"], "left").drop("_kind", "_key")


def citations(answers: DataFrame, text: str) -> DataFrame:
    """label and target of each Markdown link of an answer."""
    links = F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]\(([^)\s]+)\)"), F.lit(0))
    rows = answers.select(*[c for c in answers.columns if c != text], F.explode(links).alias("_l"))
    pattern = r"^\[([^\]]*)\]\(([^)\s]+)\)$"
    return rows.withColumns({"label": F.regexp_extract("_l", pattern, 1), "target": F.regexp_extract("_l", pattern, 2)}).drop("_l")


def named_documents(docs: DataFrame, name: str, wanted: str) -> DataFrame:
    """Documents with exactly the wanted name (with or without .pdf); without any, those that contain it."""
    low, query = F.lower(F.regexp_replace(name, r"(?i)\.pdf$", "")), wanted.lower().removesuffix(".pdf")
    tier = F.when(low == query, 0).when(F.contains(low, F.lit(query)), 1)
    ranked = docs.withColumn("_tier", tier).filter("_tier IS NOT NULL")
    best = ranked.agg(F.min("_tier").alias("_best"))
    return ranked.join(F.broadcast(best), F.col("_tier") == F.col("_best")).drop("_tier", "_best")  # one row


#: Fixed value: how periods are written inside a sentence.
PERIOD_WORDS = r"((?:fy|cy)?20\d{2}(?:\s*(?:年|[eaf]|h[12]|q[1-4]|[上下]半年|[一二三四1-4]季度))*|(?:fy|cy|[1-4]q|q[1-4]|[12]h|h[12])\d{2}|(?<!\d)\d{2}[eaf年])"


def period_quoted(canonical: Column, text: Column) -> Column:
    """Whether one of the periods that a text names is the canonical one; other digits of the text don't count."""
    named = F.regexp_extract_all(F.lower(nfkc(text)), F.lit(PERIOD_WORDS), F.lit(1))
    return F.coalesce(F.exists(named, lambda p: is_period(p, canonical)), F.lit(False))
