"""Every operator on tables with clashing, dotted, upper-case, nested and map columns, with nulls, repeated rows, and empty."""

import pytest

from lakeloom.llm import decontamination, html_text, importance, language_id, line_dedup, mixing, quality_rules, secrets, sharding, similarity_join

LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "s1"), (2, LONG, "en", "s2"), (3, "der Hund und die Katze\nund noch eine Zeile\nund Schluss", "de", "s1"), (4, None, None, None), (5, "", "en", "s1"), (None, "no id at all", "en", None),
    (3, "der Hund und die Katze\nund noch eine Zeile\nund Schluss", "de", "s1"), (6, "password = hunter2hunter2", "en", "s2"), (7, "x " * 30000, "en", "s1"),
]
EXTRA = "map('k', 1) as m, array(map('k', 2)) as deep, 1 as `a.b`, 'd' as `d.e f`, named_struct('text', 'no') as d, 'x' as _hash, 0 as _task, 'y' as dropped, 'z' as hits, 1 as language, true as kept, 2 as size, 'q' as target_id, 'u' as UPPER, 5 as gone, 6 as th, 7 as `key`, 'r' as _target, 'e' as `tick``s`"


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return plain.selectExpr("*", *split(EXTRA))


def split(listed):
    """Expressions separated by commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(listed):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(listed[at:i])
            at = i + 1
    return [*out, listed[at:]]


def bench(spark):
    return spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12", 1), (None, None, 2)], "item_id long, text string, `a.b` int")


def named(spark):
    return spark.createDataFrame([(1, "x"), (None, "y")], "doc_id long, `a.b` string")


KEEPING = {
    "drop_documents": (lambda s, d: decontamination.drop_documents(d, bench(s)), 7),
    "remove_spans": (lambda s, d: decontamination.remove_spans(d, bench(s)), 9),
    "accept": (lambda s, d: language_id.accept(d), None),
    "one_of_each": (lambda s, d: similarity_join.one_of_each(d), 8),
    "dedup_lines": (lambda s, d: line_dedup.dedup_lines(d), 9),
    "redact": (lambda s, d: secrets.redact(d), 9),
    "mix": (lambda s, d: mixing.mix(d), None),
}
REPORTING = {
    "op1": lambda s, d: decontamination.report(d, bench(s)),
    "op2": lambda s, d: secrets.report(d),
    "op3": lambda s, d: importance.select(d, named(s)),
    "op4": lambda s, d: similarity_join.similar_classes(d),
    "op5": lambda s, d: html_text.report(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"})),
    "op6": lambda s, d: mixing.report(d),
    "op7": lambda s, d: line_dedup.report(d),
    "op8": lambda s, d: language_id.report(d),
    "op9": lambda s, d: quality_rules.judge(d),
    "op10": lambda s, d: sharding.shards(d),
}


@pytest.mark.parametrize("name", KEEPING)
def test_operators_that_keep_columns(spark, docs, name):
    make, n = KEEPING[name]
    out = make(spark, docs)
    rows = out.collect()
    assert out.columns == docs.columns and (n is None or len(rows) == n)
    by_id = {r["doc_id"]: r for r in docs.collect()}
    untouched = [c for c in docs.columns if c != "text"]
    assert all(tuple(r[c] for c in untouched) == tuple(by_id[r["doc_id"]][c] for c in untouched) for r in rows)
    assert make(spark, docs.limit(0)).count() == 0


def test_sharding_keeps_columns(spark, docs):
    out = sharding.assign(docs)
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.columns == [c for c in docs.columns if c != "size"] + added and out.count() == len(ROWS) and sharding.assign(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", REPORTING)
def test_reports(spark, docs, name):
    assert len(REPORTING[name](spark, docs).collect()) == len(ROWS)
    assert REPORTING[name](spark, docs.limit(0)).count() == 0


def test_columns_of_dotted_names(spark, docs):
    odd = docs.withColumnsRenamed({"doc_id": "doc.id", "text": "the.text", "source": "the.source", "lang": "the.lang"})
    at = {"doc_id": "doc.id", "text": "the.text"}
    assert mixing.mix(odd, **at, source="the.source").columns == odd.columns
    assert line_dedup.dedup_lines(odd, **at).count() == 9 and decontamination.drop_documents(odd, bench(spark), text="the.text").count() == 7
    assert similarity_join.one_of_each(odd, **at).count() == 8 and language_id.accept(odd, **at, lang="the.lang").columns == odd.columns
    assert sharding.assign(odd, **at, dimensions=("the.lang", "the.source", "size")).count() == 9
    assert secrets.report(odd, **at).count() == 9 and importance.select(odd, named(spark).withColumnRenamed("doc_id", "doc.id"), **at).count() == 9
