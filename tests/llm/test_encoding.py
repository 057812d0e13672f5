import base64
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelwright.llm import bpe, records, shared
from panelwright.llm.shared import opened, shared_folder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_words_match_the_library(reference):
    rng = random.Random(1)
    alphabet = "abcdeéßñ漢字😀 \n\t'.,0123ABC　\x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["", " ", "aaaa" * 500, "ab" * 3000, "=" * 700, " " * 900 + "x", "the" * 900, "".join(rng.choice("aetino") for _ in range(4000))]
    vocabulary = bpe.vocabulary(RANKS, PATTERN)
    got = vocabulary.words.encode(texts)
    assert got == [packed(reference.encode_ordinary(t)) for t in texts]
    assert [vocabulary.decode(g).decode() for g in got] == texts


def test_both_expressions_split_alike():
    import regex

    rng = random.Random(3)
    own, split = regex.compile(PATTERN), bpe.Splitter(PATTERN)
    assert split.latin is not None
    every = "".join(map(chr, range(256)))
    texts = ["".join(rng.choice(every) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("a1 \n\x85\xa0\x1c'sé²漢") for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    assert [split.findall(t) for t in texts] == [own.findall(t) for t in texts]
    assert bpe.Splitter(r"\d+").latin is None and bpe.Splitter(r"(a+)b").findall("aab") == ["aa"]


def test_cuts_are_where_the_expression_matches():
    import regex

    rng = random.Random(6)
    own, every = regex.compile(PATTERN), "".join(map(chr, range(256)))
    assert bpe.BYTE_LEVEL == PATTERN
    texts = ["", "'", "'re", "it's 'll'd we'vex", "a  b", "a \n b", " \n", "x \n", "\n'sa", "", "'" * 3 + "s", "5's\x85 \xa0'm"]
    for held in (every, "a1 \n'!stmdrevl\x85\xa0\x1c", "' stre l", "ab  \n"):
        texts += ["".join(rng.choice(held) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    data, places, edges = bpe.cuts([t.encode("latin-1") for t in texts])
    ends, known = [*places[1:].tolist(), len(data)], set(edges.tolist())
    found = []
    for i, (a, b) in enumerate(zip(places.tolist(), ends)):
        if i in known:
            found.append([])
        else:
            found[-1].append(data[a:b].decode("latin-1"))
    assert found == [own.findall(t) for t in texts] + [[]]


def test_a_word_is_looked_up_once_for_a_run_of_texts():
    class Counted(dict):
        asked = 0

        def get(self, key, other=None):
            Counted.asked += 1
            return super().get(key, other)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    words = bpe.Words(PATTERN, lambda found: [struct.pack("<I", len(w)) for w in found])
    words.known.young = Counted()
    assert words.encode(["one two" * 1000, "漢 one", "two\n", ""])[1:] == [packed([1, 4]), packed([3, 1]), b""]
    assert Counted.asked < 30


def test_library_encodes_words_as_it_encodes_texts():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    rng = random.Random(7)
    alphabet = "abcdeéßñÿ漢字ж😀 \n\t'.,0123ABC　\x00\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["", " ", "<|endoftext|>x <|endoftext|>", "=" * 700, "ab" * 3000, " " * 900 + "x", "it's we'll 'tis"]
    texts += ["".join(map(chr, range(256)))]
    # Letters of a late version of Unicode, which the library may not class as such.
    texts += [f"ab{c}cd ef {c} {c}x" for c in "\u0558\u088f\ua7ce\U000107bb\U000323b0"]
    tool = records.Encoder(JSON, PATTERN)
    assert tool.model is not None
    want = [packed(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tool.encode(texts) == want
    tool.words.known.forget()
    tool.sizes[:] = 0  # no word's end is found
    assert tool.encode(texts) == want


def test_generations_of_words_keep_results(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KEPT", 3)
    vocabulary = bpe.Vocabulary(RANKS, PATTERN)
    for text in ("one two three four five", "two six seven one", "eight nine two one ten", "one two"):
        assert vocabulary.words.encode([text]) == [packed(reference.encode_ordinary(text))]


def test_documents_round_trip(documents, empty, reference):
    rows = bpe.encode_documents(documents, RANKS, PATTERN).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, packed(reference.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in documents.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), bytes(r.decoded)) for r in rows) == want
    assert bpe.digest_documents(empty, RANKS, PATTERN).count() == 0


def test_a_worker_holds_no_words_after_its_task(spark, documents):
    """Spark hands the worker on to later tasks, where its words would stand beside their work."""

    def held(batches):
        for batch in batches:
            table = bpe.vocabulary(RANKS, PATTERN)
            used = bpe.vocabulary.cache_info().hits > 0  # a worker that has encoded before
            known = table.words.known
            batch["id"] = len(known.young) + len(known.elder) if used else -1
            yield batch

    for encode in (bpe.encode_documents, bpe.digest_documents):
        assert encode(documents, RANKS, PATTERN).count() == documents.count()
        encode(documents, RANKS, PATTERN).write.format("noop").mode("overwrite").save()
        found = [r.id for r in spark.range(0, 40, 1, 4).mapInPandas(held, "id long").collect()]
        assert max(found) == 0  # some worker is one of those, and none holds a word


def test_free_memory_is_given_back_after_the_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(shared, "release", lambda: seen.append("given back"))

    @shared.releasing
    def run(batches):
        for batch in batches:
            seen.append(batch)
            yield batch * 2

    assert list(run(iter([1, 2]))) == [2, 4] and seen == [1, 2, "given back"]
    part = run(iter([3, 4]))
    assert next(part) == 6
    part.close()  # a task that is not read to its end
    assert seen == [1, 2, "given back", 3, "given back"]


def test_release_leaves_what_is_in_use():
    kept = np.arange(1 << 20)
    shared.release()
    assert (kept == np.arange(1 << 20)).all()


def bitwise(data):
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (records.POLYNOMIAL if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    assert records.crc32c([b"123456789"]) == [0xE3069283]  # check value of CRC-32C
    rng = random.Random(2)
    for sizes in ((4, 5, 7), (0, 1, 2, 3, 9), (1023, 1024, 1025, 4), (5000, 2048, 8, 3000)):
        data = [rng.randbytes(n) for n in sizes]
        assert records.crc32c(data) == [bitwise(d) for d in data]
    assert records.crc32c([]) == []


def test_frames_are_checked():
    payloads = [b"x" * 10, b"", b"abc"]
    data = b"".join(records.framed(payloads))
    assert records.unframed(data) == payloads
    broken = bytearray(data)
    broken[14] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        records.unframed(bytes(broken))
    with pytest.raises(ValueError, match="inside a record"):
        records.unframed(data[:-1])


def test_written_ids_read_back(spark, documents, empty):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    order = sorted(documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    want, start = [], 0
    for r in order:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    got = sorted(map(tuple, records.packed_documents(documents, JSON, PATTERN, 2).collect()), key=lambda r: r[1])
    assert got == want
    assert records.packed_documents(empty, JSON, PATTERN, 2).count() == 0


def test_blocks_and_files_are_cut(spark, documents, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 3)
    folder = shared_folder(spark, "cut")
    manifest = records.write_documents(documents, folder, JSON, PATTERN, 2)
    assert manifest.count() >= documents.count() / 3
    whole = records.read_documents(manifest).orderBy("start").collect()
    shuffled = records.read_shuffled(manifest, 7).collect()
    assert [r.position for r in shuffled] == sorted(r.position for r in shuffled)
    assert sorted(bytes(r.ids) for r in shuffled) == sorted(bytes(r.ids) for r in whole)
    other = records.read_shuffled(manifest, 8).collect()
    assert [r.doc_id for r in other] != [r.doc_id for r in shuffled]
    row = manifest.first()
    system, at = opened(row.archive + ".idx")
    with system.open_input_stream(at, compression=None) as stream:
        assert len(np.frombuffer(stream.read(), dtype="<u8")) % 2 == 0
