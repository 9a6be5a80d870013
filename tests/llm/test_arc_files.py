"""ARC files of bounded size."""

import gzip

from gazette.llm import warc


def test_files_roll_by_size_and_read_back(spark, tmp_path):
    """Small files, each with its version block; a document larger than a file is one of its own; what is read does not depend on the size."""
    pages = [(i, f"http://h/{i}", None if i == 3 else "p\né" * (5 * i)) for i in range(40)] + [(99, None, "x" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    read = {}
    for roll in (300, 10**9):
        path = str(tmp_path / f"arc{roll}")
        warc.write_arc(df, path, roll=roll)
        files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / f"arc{roll}").glob("*.gz")]
        files = [f for f in files if f]
        assert all(f.startswith(b"filedesc://part-") and f.count(b"filedesc://") == 1 for f in files)
        assert all(len(list(warc.arc_records(f))) >= 1 for f in files)
        assert len(files) > 10 if roll == 300 else len(files) == 2
        read[roll] = sorted(tuple(r) for r in warc.read_arc(spark, path).select("page_id", "payload_bytes", "sha1", "url", "html").collect())
    assert read[300] == read[10**9] and len(read[300]) == 41
    warc.convert(spark, str(tmp_path / "arc300"), str(tmp_path / "warc"))
    assert sorted((r.page_id, r.html) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()) == sorted((i, h or "") for i, _, h in pages)
