"""Files in, routes, and the streaming facade."""

from pyspark.sql import functions as F

from stratalex.operators.corpus import Corpus
from stratalex.schemas import DOCUMENTS, TARIFF_LINES
from stratalex.sources.documents import decode_documents, expand_frames, list_inputs, pasted_text, read_schedule, recognise_pages, sorted_inputs
from stratalex.streaming.documents import classify_stream

TEXT = "SL-20 Clear silicone sealant 10\n4 x Garden hose reel\nand some more letters to be enough"


def test_files(spark, tmp_path):
    def decode(path, content):
        if b"broken" in content:
            raise ValueError("no")
        return content[5:].decode(), [[["a", None]]], None

    (tmp_path / "sub").mkdir()
    for name, data in {"b.pdf": b"%PDF-" + TEXT.encode(), "sub/a.PDF": b"%PDF-x", "c.png": b"img", "d.docx": b"?", "e.pdf": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    assert [r.path.split("/")[-1] for r in sorted_inputs(spark, str(tmp_path)).collect()] == ["b.pdf", "c.png", "e.pdf", "a.PDF"]
    assert sorted(bytes(r.content) for r in list_inputs(spark, str(tmp_path)).collect())[-1] == b"img"
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = {r.source_file: r for r in decode_documents(every, decode, lambda p, c: ["", "seen " + c.decode()]).collect()}
    assert {k: r.route for k, r in got.items()} == {"b.pdf": "digital_pdf", "a.PDF": "scanned_pdf", "c.png": "image", "d.docx": "unsupported", "e.pdf": "scanned_pdf"}
    assert got["b.pdf"].text == TEXT and got["b.pdf"].tables == [[["a", None]]] and got["c.png"].text == "seen img"
    assert got["e.pdf"].warnings == ["Decoding failed: no", "No product lines were found after OCR of the PDF pages."] and got["d.docx"].warnings == ["Unsupported file type 'docx'."]
    blank = {r.source_file: r for r in decode_documents(every, decode, lambda p, c: []).collect()}
    assert blank["a.PDF"].warnings == ["The PDF had no text layer and no pages could be rendered."] and blank["c.png"].warnings == ["No product lines were found in the image."]
    plain = {r.source_file: r for r in decode_documents(every, decode).collect()}
    assert plain["a.PDF"].warnings == ["The PDF had no text layer and no pages could be rendered."]
    (tmp_path / "s.txt").write_text("CHAPTER 1\nx")
    assert read_schedule(spark, str(tmp_path / "s.txt")).first().text == "CHAPTER 1\nx"
    assert pasted_text(spark, "x").select(*[c.split()[0] for c in DOCUMENTS.split(", ")]).count() == 1


def test_stream(spark, tmp_path):
    line = (1, "3214.10.00", "3214.10.00", "32141000", "1", "32", "3214", "Mastics", "Mastics", "Mastics", "kg", "Free", None, None, None, None, None, True, 1)
    corpus = Corpus(spark.createDataFrame([line], TARIFF_LINES), "2026-08-28")
    pasted_text(spark, TEXT, "one").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DOCUMENTS).parquet(str(tmp_path / "in"))
    classify_stream(stream, corpus, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter(F.col("line_number") == 1).first()
    assert (got.source_file, got.hs_code, got.part_number) == ("one", "3214.10.00", "SL-20")


def test_pages_are_read_again(spark):
    """A row for each page; a poor reading is tried once more, and the better one counts."""

    def frames(path, content):
        if content == b"broken":
            raise ValueError
        return content.split(b"|")

    def read(frame, way):
        text = frame.decode()
        if text == "fails":
            raise ValueError
        return text if way == "plain" else {"few": "more letters than before, many of them", "abc": "a"}.get(text, "")

    files = spark.createDataFrame([("a", b"few|abc|letters enough for a reading"), ("b", b"broken"), ("c", b"fails")], "path string, content binary")
    got = recognise_pages(expand_frames(files, frames), read).collect()
    assert {(r.path, r.page): (r.text, r.tries) for r in got} == {("a", 1): ("more letters than before, many of them", 2), ("a", 2): ("abc", 2), ("a", 3): ("letters enough for a reading", 1), ("c", 1): ("", 2)}


def test_frames_of_small_files_go_together(spark):
    """A thousand files of two frames each are one table, not one each; large frames are parted by their bytes."""
    import pandas as pd

    from stratalex.sources import documents as d

    class Files:
        sparkSession = spark
        select = lambda self, *_: self
        mapInPandas = lambda self, f, schema: f

    run = d.expand_frames(Files(), lambda path, content: [content, content])
    few = list(run(iter([pd.DataFrame({"path": [f"f{k}" for k in range(1000)], "content": [b"x"] * 1000})])))
    assert len(few) == 1 and len(few[0]) == 2000 and list(few[0]["page"][:3]) == [1, 2, 1]
    large = list(run(iter([pd.DataFrame({"path": ["a", "b"], "content": [b"x" * 3_000_000] * 2})])))
    assert sum(map(len, large)) == 4 and all(t["frame"].map(len).sum() < d.BATCH_BYTES + 3_000_001 for t in large) and len(large) == 2
