import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loreforge.llm import token_files
from loreforge.llm.subwords import Encoder, crc, public

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
CODERS = {f: Encoder(public(f), memory=50) for f in FILES}
PLAIN = {f: Tokenizer.from_file(public(f)) for f in FILES}
TEXTS = ["", " ", "\n\n The cat's  toy.\n\nIt'll (not) break,  he said...\t", "a  b \n c\n\nD", "naïve Çé ñ, ü.", "日本語 text", "x y  z", "é e", "don't'they'rest 'tis", "<|endoftext|> <|startoftext|>", "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b", "<|startoftext|>the <|", "a1b2 3,4  5", "—, — x", "İ ǅ", "\x1c a\x85"]


def whole(name, text):
    """By the library alone."""
    return PLAIN[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_the_whole(name):
    coder = CODERS[name]
    for text, ids in zip(TEXTS, coder.encode(TEXTS), strict=True):
        assert ids.tolist() == whole(name, text), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "'s", "'", "the", "The", "é", "Ñ", "1", "23", ",", ".", "...", "(", "x", "re", "ll", "—", "日", "<", "<|", "|>", "endoftext", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>"]), max_size=25))
def test_random_texts(parts):
    text = "".join(parts)
    for name, coder in CODERS.items():
        assert coder.encode([text])[0].tolist() == whole(name, text)


def test_round_trip_through_files(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "gamma.", "Delta"]) for _ in range(rng.randrange(300))), "x") for i in range(399)]
    rows += [(399, "one <|endoftext|> two", "x"), (400, None, "x"), (401, "", "x"), (402, "long " * 60_000, "x"), (None, "no id", "x"), (7, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    manifest = token_files.write(docs, public(FILES[0]), end_id=1)
    got = token_files.read(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start, left = 0, {}
    for i, text, _ in rows:
        left.setdefault(i, []).append(whole(FILES[0], text or "") + [1])
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        assert any(len(ids) == r["n_tokens"] and crc(np.array(ids)) == r["ids_crc32"] for ids in left[r["doc_id"]])
    m = manifest.collect()[0]
    shard = token_files.Shard(m["tokens"], m["docs"])
    assert shard.sequence(0).base is not None and len(shard.sequence(0)) == token_files.LENGTH
    last = (m["n_ids"] - 1) // token_files.LENGTH
    assert sum(shard.mask(last).to_pylist()) == (m["n_ids"] - 1) % token_files.LENGTH + 1


def test_shards_end_at_their_size(spark):
    rng = random.Random(2)
    rows = [(i if i % 3 else None, " ".join(rng.choices(["alpha", "beta,", "Delta"], k=rng.randrange(200)))) for i in range(600)] + [(601, "long " * 9000), (602, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    manifest = token_files.write(docs, public(FILES[0]), shard_ids=2000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = manifest.orderBy("task", "part").collect()
    assert all(r["part"] == 0 or shards[k - 1]["n_ids"] >= 2000 for k, r in enumerate(shards)) and max(r["part"] for r in shards) > 2
    assert sum(r["n_docs"] for r in shards) == len(rows)
    got = token_files.read(manifest).orderBy("start").collect()
    # rows without an id lie in more than one range
    assert sum(any(i is None for b in token_files.Shard(r["tokens"], r["docs"]).index for i in b.column(0).to_pylist()) for r in shards if r["part"] == 0) > 1
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert all(b["start"] - a["start"] == a["n_tokens"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0
    want = sorted((i or 0, crc(np.array(whole(FILES[0], t) + [1]))) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(docs, public(FILES[0]))).count() == 0
