import hashlib
import io

import pytest

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


@pytest.mark.parametrize("most", [warc.MOST_COPIES, 0])
def test_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_COPIES", most)
    big, small = "<p>" + "x" * 200 + "é</p>", "<p>x</p>"
    rows = [(5, "http://a/ b", big), (2, None, big), (9, "u", big), (1, "u", small), (3, "u", small), (4, "u", None), (6, "u", ""), (None, "u", big), (2, "u", big), (7, "u", "y" * 100), (8, "u", "y" * 100), (11, "u", "<p>long " + "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.archive_round_trip(spark, pages).collect()), key=repr)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == b and k is not None]
        first = min(same, default=None)
        again = len(b) >= 100 and i is not None and first < i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_archive_has_a_dictionary_and_single_frames():
    records = [warc.encode_record(i, "http://x", (b"<html>" + b"common words " * 20) + bytes([i % 250]) * 50, 10, "d", None) for i in range(300)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    raw = out.getvalue()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    assert len(raw) < sum(map(len, records)) / 2


def test_attempts_do_not_share_names(spark, tmp_path):
    """Archives that another attempt has left in the folder are not read."""
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50, "x") for i in range(20)], SCHEMA)
    records = warc.plan_records(pages)
    first = {r.archive for r in warc.write_archives(records, str(tmp_path), 1000).collect()}
    listing = warc.write_archives(records, str(tmp_path), 1000)
    listing.write.parquet(str(tmp_path / "list"))
    listed = spark.read.parquet(str(tmp_path / "list"))
    assert not first & {r.archive for r in listed.collect()}
    assert sorted(r.page_id for r in warc.read_archives(listed, str(tmp_path)).collect()) == list(range(20))
