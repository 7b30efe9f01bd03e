"""The pipeline against its stages in plain Python, and each stage on awkward documents."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from embergrid.llm import mixing, stages
from embergrid.llm.common import read_table
from tests.llm.data import BASE, CLASHING, awkward_rows, documents, near
from tests.llm.test_bpe import library  # noqa: F401
from tests.llm.test_join import sets_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def smallest_of_groups(texts):
    """Smallest id of each group of linked texts, by counting common shingles."""
    sets = {k: sets_of(text) for k, text in texts.items()}
    places = defaultdict(list)
    for k, shingles in sets.items():
        for shingle in shingles:
            places[shingle].append(k)
    label = {k: k for k in texts}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, shingles in sets.items():
        for other, both in Counter(o for shingle in shingles for o in places[shingle] if o < k).items():
            if 100 * both >= 75 * (len(shingles) + len(sets[other]) - both):
                one, two = sorted((root(k), root(other)))
                label[two] = one
    return {root(k) for k in texts}


def test_stages_follow_one_another(spark, sf_dir, library):  # noqa: F811
    docs = read_table(spark, sf_dir, "documents")
    rows = {row["doc_id"]: row for row in docs.collect()}
    kept = set(rows)
    for (name, stage), step in zip(corpus_pipeline.STAGES[:4], range(4)):
        out = stage(spark, docs.where(docs["doc_id"].isin(list(kept))), sf_dir)
        assert out.columns == docs.columns, name
        found = {row["doc_id"] for row in out.select("doc_id").collect()}
        assert found <= kept
        if step == 0:
            assert found == {k for k in kept if any(letter.isalpha() for letter in rows[k]["text"] or "")}
        if step == 1:
            last = {}
            for k in sorted(kept):
                last[(rows[k]["text"] or "").encode().lower()] = k
            assert found == set(last.values())
        if step == 2:
            assert found == smallest_of_groups({k: rows[k]["text"] for k in kept})
        if step == 3:
            words = {k: len((rows[k]["text"] or "").encode().split()) for k in kept}
            assert sum(words[k] for k in found) <= sum(words.values()) * stages.MIX_PERCENT // 100
            assert sum(words[k] for k in found) > 0.5 * sum(words.values())
        kept = found
    result = {row["doc_id"]: row for row in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(result) == kept
    for k in sorted(kept)[:200]:
        ids = library.encode_ordinary(rows[k]["text"])
        assert result[k]["n_tokens"] == len(ids) and len(result[k]["ids"]) == 4 * len(ids)


def test_stages_on_awkward_documents(spark, sf_dir):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert 0 < len(rows) <= len(awkward_rows()), name
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
        assert stage(spark, documents(spark, []), sf_dir).collect() == [], name


def test_mix_takes_each_document_once(spark, sf_dir):
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    out = stages.mixing_stage(spark, docs, sf_dir)
    assert out.count() == out.select("doc_id").distinct().count()
    assert mixing.with_tree(docs).count() == docs.count()


def test_null_and_shared_ids_keep_their_texts(spark, sf_dir):
    texts = {
        None: ["n1 some text", "n2 other text", "N2 OTHER text", BASE, near(BASE, 1, 3), near(BASE, 40, 4)],
        5: ["five one", "five two", "shared text", near(BASE, 35, 9), near(BASE, 35, 9) + "  "],
        6: ["shared text", "six one", near(BASE, 45, 2), near(BASE, 45, 2) + " z"],
    }
    rows = [(k, text, "en", "s", 1) + CLASHING for k, many in texts.items() for text in many]
    for repeated in ([], [rows[0]], [rows[8], rows[8], rows[2]]):
        docs = documents(spark, rows + repeated)
        groups = {}
        for row in rows + repeated:
            groups.setdefault(row[1].lower(), []).append(row[0])
        largest = {text: max(ids, key=lambda k: -1 if k is None else k) for text, ids in groups.items()}
        out = stages.exact_dedup_stage(spark, docs, sf_dir).collect()
        found = Counter((row["doc_id"], row["text"].lower()) for row in out)
        assert found == Counter((k, text) for text, k in largest.items())
        kept = [tuple(row) for row in out]
        deduped = documents(spark, kept)
        heads = stages.jaccard_stage(spark, deduped, sf_dir).collect()
        # One row for each group of linked rows, with the smallest id of the group.
        labels = list(range(len(kept)))
        sets = [sets_of(row[1]) for row in kept]
        for i in range(len(kept)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    labels = [labels[j] if at == labels[i] else at for at in labels]
        smallest = Counter(
            min((row[0] for row, at in zip(kept, labels) if at == label and row[0] is not None), default=None)
            for label in set(labels)
        )
        assert Counter(row["doc_id"] for row in heads) == smallest
        assert {row["text"] for row in heads} <= {row[1] for row in kept} and len({row["text"] for row in heads}) == len(heads)
        mixed = stages.mixing_stage(spark, deduped, sf_dir).collect()
        words = sum(len(row[1].split()) for row in kept)
        assert 0 < sum(len(row["text"].split()) for row in mixed) <= words * stages.MIX_PERCENT // 100
