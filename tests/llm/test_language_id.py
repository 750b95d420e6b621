import random
import zlib
from collections import Counter

import numpy as np

from lakeloom.llm import language_id as li


def test_profiles_by_brute_force():
    letters = li.letter_table()
    text = "Über 2 Äpfel, über!"
    words = ["über", "äpfel", "über"]
    found = {}
    for w in words:
        p = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if g.strip() and not (n == 3 and g[1] == " "):
                    found[g] = found.get(g, 0) + 1
    codes, counts = np.unique(li.ngrams(text.encode(), letters), return_counts=True)
    decode = lambda c: "".join(chr(x) for x in (c & 0x1FFFFF, c >> 21 & 0x1FFFFF, c >> 42) if x)
    assert {decode(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == found


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = li.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() >= 0.95 and out.score.between(0, 1).all()


def brute(rows):
    """(held out, language, score, size of the profile) by doc_id, with plain dictionaries, of rows (doc_id, text, lang)."""

    def counts(text):
        found = Counter()
        for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            p = f" {w} "
            found.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")
        return found

    def ordered(found):
        # Ties by the code of the n-gram: its last letter counts most.
        return sorted(found, key=lambda g: (-found[g], tuple(ord(c) for c in reversed(g.ljust(3, "\0")))))[: li.LENGTH]

    summed = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5 and lang is not None:
            summed.setdefault(lang, Counter()).update(counts(text))
    profiles = {lang: {g: i for i, g in enumerate(ordered(c))} for lang, c in summed.items()}
    want = {}
    for i, text, _ in rows:
        own = ordered(counts(text))
        away = {lang: sum(abs(p[g] - k) if g in p else li.LENGTH for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        want[i] = (zlib.crc32(str(i).encode()) % 5 == 0, best if own else "und", 1 - away[best] / (li.LENGTH * len(own)) if own else 0.0, len(own))
    return want


def test_prediction_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()])
    for r in li.report(docs).collect():
        held, lang, score, _ = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held, lang) and abs(r.score - score) < 1e-9


def test_accept_drops_what_is_no_learned_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(4)
    n = docs.count()

    def shuffled(text):
        letters = [c for c in text if c.isalpha()]
        rng.shuffle(letters)
        return "".join(letters.pop() if c.isalpha() else c for c in text)

    long = [r for r in docs.collect() if len(r.text) > 300]
    rows = [(n + i, shuffled(r.text)) for i, r in enumerate(long)]
    first = n + len(rows)
    rows += [(first, "qzxv kjqw zzxq vvkq wqzz xkjq"), (first + 1, "Siedzialem w domu i czytalem ksiazke o historii naszego kraju kiedy nagle zadzwonil telefon"), (first + 2, "Привет мир это русский текст"), (first + 3, "123 456"), (first + 4, None)]
    other = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'x' source", "cast(1 as bigint) n_chars")
    kept = {r.doc_id for r in li.accept(docs.unionByName(other)).select("doc_id").collect()}
    assert len([i for i in kept if i < n]) >= 0.99 * n
    assert not [i for i in kept if i >= first] and len([i for i in kept if n <= i < first]) <= 0.1 * len(long)


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !?", None), (None, "the dog", "en"), (6, "und " * 40000, None), (6, "the the", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, language double")
    got = {(r.doc_id, r.lang_pred) for r in li.predict(df, li.learn(df)).selectExpr("doc_id", "language.lang as lang_pred").collect()}
    assert got >= {(3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "en")}
    assert {r.lang_pred for r in li.report(df.limit(0)).collect()} == set()
    none = li.report(df.withColumn("lang", df.lang.substr(0, 0)).where("false").unionAll(spark.createDataFrame([(1, "x", None, 0.5)], df.schema)))
    assert none.first().lang_pred == "und"
    assert li.accept(df).columns == df.columns and {r.doc_id for r in li.accept(df).collect()} >= {1, 2}
    held = {r.doc_id: r.h for r in df.select("doc_id", li.held_out("doc_id").alias("h")).collect()}
    assert held[None] is True


def test_every_labelled_row_teaches(spark):
    # More rows of a language than any sample of thousands: each brings a letter of its own.
    rows = [(i, chr(0x4E00 + i), "zh") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(li.learn(df, length=50_000)[1]) == 4 * len(rows)
    one = spark.createDataFrame([(i, "der Hund und die Katze gehen in den Wald hinein" if i < 5000 else "qqqq wwww xxxx zzzz", "de") for i in range(10_000)], "h int, text string, lang string")
    model = li.profiles_of({"de": li.top(li.ngrams("der Hund und die Katze gehen in den Wald hinein".encode(), li.letter_table()), li.LENGTH).tolist()})
    # Half of the rows read like nothing known, so their scores are the 1 % quantile.
    assert max(li.least_scores(one, model)) < max(li.least_scores(one.where("h < 5000"), model))
