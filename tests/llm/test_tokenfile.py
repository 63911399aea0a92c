import io

import numpy as np
import pytest
import zstandard

from glossa.llm import bpe, runtime, tokenfile


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    writer = tokenfile.Writer(out)
    frames = [b"", b"abc" * 100, bytes(range(256)) * 50]
    for f in frames:
        writer.add(f)
    writer.close()
    data = out.getvalue()
    reader = tokenfile.Reader(io.BytesIO(data))
    assert [reader.frame(i) for i in (2, 0, 1)] == [frames[2], frames[0], frames[1]]
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as plain:
        assert plain.read() == b"".join(frames)
    at = int(reader.at[2]) + 12
    damaged = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
    bad = tokenfile.Reader(io.BytesIO(damaged))
    assert bad.frame(1) == frames[1]
    with pytest.raises(ValueError):
        bad.frame(2)
    for cut in (b"", data[:-1], data[:40]):
        with pytest.raises(ValueError):
            tokenfile.Reader(io.BytesIO(cut)).frame(2)


def test_only_asked_frames_are_read():
    out = io.BytesIO()
    writer = tokenfile.Writer(out)
    for i in range(100):
        writer.add(np.random.default_rng(i).bytes(1000))
    writer.close()

    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            data = super().read(n)
            Counting.total += len(data)
            return data

    reader = tokenfile.Reader(Counting(out.getvalue()))
    Counting.total = 0
    reader.frame(57)
    assert Counting.total < 1100


def test_round_trip(spark):
    rows = [(1, "the end of it"), (2, None), (3, ""), (4, "é" * 30_000), (4, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = runtime.new_path(spark, "test-tokens")
    manifest = tokenfile.write_tokens(docs, folder)
    assert manifest.count() == 6
    tokens = tokenfile.read_tokens(spark, folder)
    texts = bpe.decode(tokens).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in texts) == sorted((r[0] or 0, r[1] or "") for r in rows)
    some = tokenfile.read_tokens(spark, folder, spark.createDataFrame([(1,), (3,), (99,)], "doc_id long")).collect()
    assert sorted((r.doc_id, len(r.tokens)) for r in some) == [(1, 4), (3, 0)]


def test_empty_table_and_orphans(spark):
    folder = runtime.new_path(spark, "test-tokens")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert tokenfile.write_tokens(docs.limit(0), folder).count() == 0
    system, path = tokenfile._open(folder)
    with system.open_output_stream(f"{path}/part-000000-lost.zst") as f:
        f.write(b"x")
    folder2 = runtime.new_path(spark, "test-tokens")
    system.create_dir(tokenfile._open(folder2)[1])
    with system.open_output_stream(f"{tokenfile._open(folder2)[1]}/part-000000-lost.zst") as f:
        f.write(b"x")
    manifest = tokenfile.write_tokens(docs, folder2)
    left = [i.base_name for i in system.get_file_info(tokenfile.fs.FileSelector(tokenfile._open(folder2)[1])) if i.base_name.endswith(".zst")]
    assert left == [manifest.first().shard]


def test_related_words_keep_their_ids(spark, tmp_path):
    """Unlike words whose polynomials modulo 2**64 are equal; the manifest against a count of its own."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), None, "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/tokens"
    manifest = {r.doc_id: r for r in tokenfile.write_tokens(docs, folder).collect()}
    model = bpe.Bpe(bpe.read_ranks())
    for r in tokenfile.read_tokens(spark, folder).collect():
        want = [t for piece in ([texts[r.doc_id]] if r.doc_id < 3 else ["x", " y"]) for t in model.merge((piece or "").encode())]
        assert r.tokens == want
        m = manifest[r.doc_id]
        data = np.array(want, "<u2").tobytes()
        assert m.n_tokens == len(want) and m.width == 2 and m.checksum == tokenfile.checksum(data)
        assert m.frame_bytes == len(zstandard.ZstdCompressor(level=tokenfile.LEVEL, write_content_size=True).compress(data))
