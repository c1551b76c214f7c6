"""Readers, writers and streams over files in a temporary folder."""

import itertools
import json
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import quality as Q
from scriptloom.operators import verify as V
from scriptloom.sources import encodings as E
from scriptloom.sources import publishing as B
from scriptloom.sources import readers as R
from scriptloom.sources import sinks as K
from scriptloom.streaming import receipts as W


def test_scripts_round_trip_or_are_refused(spark, tmp_path):
    files = {
        "utf8.txt": "甲乙﻿丙\r\n".encode(), "mark.txt": b"\xef\xbb\xbf" + "甲".encode(), "utf16.txt": b"\xff\xfe" + "甲".encode("utf-16-le"),
        "gb.txt": "剧本：第一集".encode("gb18030"), "bad.txt": b"\xff\xff\xff", "empty.txt": b"",
        "big5.txt": "夜裡的街道下著雨，他們慢慢走回家。".encode("big5"), "wide.txt": "INT. KITCHEN\r\n".encode("utf-16-le"), "wide2.txt": "夜里的街道下着雨。".encode("utf-16-be"),
        "nul.txt": b"a\x00b\r\n", "a b%20c.txt": b"", "old.txt": "張三走進房間，看著窗外的雨，聽見遠處傳來鐘聲。".encode("gb18030"), "names.txt": "王琦瑶、孙婷婷、赵馨怡".encode("gb18030"), "two.txt": "王婷".encode("gb18030"),
        "cafe.txt": "Scene 1: café — naïve".encode("gb18030"), "le.txt": "夜里的街道下着雨。".encode("utf-16-le"), "one.txt": "甲".encode("gb18030"),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    scripts, rejects = R.read_scripts(spark, str(tmp_path))
    found = {r.path.rsplit("/")[-1]: (r.charset, r.text) for r in scripts.collect()}
    assert found == {
        "utf8.txt": ("UTF-8", "甲乙﻿丙\r\n"), "mark.txt": ("UTF-8", "甲"), "utf16.txt": ("UTF-16", "甲"), "gb.txt": ("GB18030", "剧本：第一集"), "empty.txt": ("UTF-8", ""),
        "big5.txt": ("Big5", "夜裡的街道下著雨，他們慢慢走回家。"), "wide.txt": ("UTF-16", "INT. KITCHEN\r\n"), "wide2.txt": ("UTF-16", "夜里的街道下着雨。"),
        "nul.txt": ("UTF-8", "a\x00b\r\n"), "a b%20c.txt": ("UTF-8", ""), "old.txt": ("GB18030", "張三走進房間，看著窗外的雨，聽見遠處傳來鐘聲。"), "names.txt": ("GB18030", "王琦瑶、孙婷婷、赵馨怡"), "two.txt": ("GB18030", "王婷"),
        "cafe.txt": ("GB18030", "Scene 1: café — naïve"), "le.txt": ("UTF-16", "夜里的街道下着雨。"),
    }
    assert sorted((r.path.rsplit("/")[-1], r.reason) for r in rejects.collect()) == [("bad.txt", "not decodable"), ("one.txt", "ambiguous encoding")]


@pytest.mark.parametrize("codec", ["gb18030", "big5", "utf-16-le"])
def test_long_files_are_decoded_in_pieces(codec):
    text = "夜裡，他慢慢走回家。" * (2 * E.PIECE // 13) + "end"
    charset, found, reason = E.decode(text.encode(codec))
    assert reason is None and bytes(found).decode() == text and charset == {"gb18030": "GB18030", "big5": "Big5", "utf-16-le": "UTF-16"}[codec]
    assert E.decode(text.encode(codec)[:-1] + b"\xff")[1] is None or codec == "utf-16-le"


def test_broken_utf8_with_accents_is_not_utf16():
    for text in ("é à ç ü ñ", "Çà été, là où ça gêne. ", "夜里的街道下着雨"):
        for n in (40, 41):
            assert E.decode(b"\xff\x00\xff" + (text * n).encode()) == (None, None, "not decodable")


def test_short_broken_utf8_is_not_utf16():
    for text in ("This.", "Die tz.", "Ereaea.", "a", "0", "NGO", "for for f", "! STSHT", "\nAll righ"):
        assert E.decode(b"\xff\x00\xff" + text.encode()) == (None, None, "not decodable")
    text = "夜家传来传来道传里走道来他来他看家来雨家"  # of its UTF-16 bytes more than three quarters are printable
    for codec in ("utf-16-le", "utf-16-be"):
        charset, found, reason = E.decode(text.encode(codec))
        assert (charset, bytes(found).decode(), reason) == ("UTF-16", text, None)


def test_fdx_round_trip(spark, tmp_path):
    rows = [(1, 0, "Scene Heading", "INT. A & B <day>"), (1, 1, "Action", "  spaced  "), (2, 0, "Character", "甲")]
    elements = spark.createDataFrame(rows, "script_id long, element_idx int, element string, text string")
    K.write_fdx(elements, str(tmp_path / "x"))
    back = R.read_fdx(spark, str(tmp_path / "x"))
    assert sorted((int(r.script_id), r.element_idx, r.element, r.text) for r in back.collect()) == rows


def test_fdx_runs_are_joined(spark, tmp_path):
    (tmp_path / "a.fdx").write_text(
        "<FinalDraft><Content><Paragraph Type='Action'><Text>She </Text><Text Style='Bold'>waits</Text><Text> </Text><Text>here.</Text></Paragraph>"
        "<Paragraph Type='Action'/><Paragraph Type='General'><Text></Text></Paragraph></Content></FinalDraft>"
    )
    assert [(r.element, r.text) for r in R.read_fdx(spark, str(tmp_path / "a.fdx")).orderBy("element_idx").collect()] == [("Action", "She waits here."), ("Action", ""), ("General", "")]


def test_fdx_dual_dialogue_and_titles(spark, tmp_path):
    one = "<Paragraph Type='Character'><Text>{}</Text></Paragraph><Paragraph Type='Dialogue'><Text>Go{}</Text></Paragraph>"
    (tmp_path / "a.fdx").write_text(
        "<FinalDraft><Content><Paragraph Type='Action'><Text>They speak.</Text></Paragraph><Paragraph><DualDialogue>" + one.format("ANNA", 1) + one.format("BOB", 2) + "</DualDialogue></Paragraph>"
        "<Paragraph><Text>no type</Text></Paragraph><Paragraph><DualDialogue>" + one.format("C", 3) + "</DualDialogue></Paragraph><Paragraph Type='Action'><Text>End.</Text></Paragraph></Content>"
        "<TitlePage><Content><Paragraph Alignment='Center'><Text>The </Text><Text Style='Bold'>Title</Text></Paragraph><Paragraph/></Content></TitlePage></FinalDraft>"
    )
    read = lambda path: [(r.element, r.text, r.dual) for r in R.read_fdx(spark, path).orderBy("element_idx").collect()]
    expected = [("Action", "They speak.", None), ("Character", "ANNA", 1), ("Dialogue", "Go1", 1), ("Character", "BOB", 1), ("Dialogue", "Go2", 1), ("Character", "C", 2), ("Dialogue", "Go3", 2), ("Action", "End.", None)]
    assert read(str(tmp_path / "a.fdx")) == expected
    K.write_fdx(R.read_fdx(spark, str(tmp_path / "a.fdx")), str(tmp_path / "b"))
    assert read(str(tmp_path / "b")) == expected
    assert [r.text for r in R.read_fdx_titles(spark, str(tmp_path / "a.fdx")).orderBy("line_idx").collect()] == ["The Title", ""]


def test_packs_and_manifests(spark, tmp_path):
    (tmp_path / "pack.json").write_text(json.dumps([{"id": "a", "prompt": "p", "category": "c", "title": "t"}]))
    card = R.read_style_pack(spark, str(tmp_path / "pack.json")).first()
    assert (card.id, card.prompt) == ("a", "p") and card.source_path.endswith("pack.json")
    folder = tmp_path / "sets" / "one.imageset"
    folder.mkdir(parents=True)
    (folder / "Contents.json").write_text(json.dumps({"images": [{"filename": "a.png"}, {"filename": "b.png"}]}))
    (folder / "a.png").write_bytes(b"")
    faults = Q.resource_faults(*R.read_image_sets(spark, str(tmp_path / "sets")))
    assert [(r.set_name, r.filename) for r in faults.collect()] == [("one.imageset", "b.png")]


def published(spark, path):
    return sorted(tuple(r) for r in B.read_published(spark, path).collect())


def test_publishing_keeps_the_last_good_result(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        B.read_published(spark, path)
    old = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old"), (None, "nobody")], "script_id long, v string")
    every = spark.createDataFrame([(1, True), (2, True), (3, True)], "script_id long, complete boolean")
    B.publish_if_complete(old, every, path)
    new = spark.createDataFrame([(1, "new"), (1, "new"), (2, "new")], "script_id long, v string")
    B.publish_if_complete(new, every.withColumn("complete", F.col("script_id") != 2), path)  # 3 is complete and has no rows now
    assert published(spark, path) == [(1, "new"), (1, "new"), (2, "old")]


def test_a_failed_publisher_leaves_nothing(spark, tmp_path):
    path, every = str(tmp_path / "out"), spark.range(1, 9).select(F.col("id").alias("script_id"), F.lit(True).alias("complete"))
    B.publish_if_complete(every.select("script_id", F.lit("old").alias("v")), every, path)
    there = sorted(str(p) for p in (tmp_path / "out").rglob("*"))
    broken = every.select("script_id", F.when(F.col("script_id") == 8, F.raise_error(F.lit("broken"))).otherwise("new").alias("v"))
    with pytest.raises(Exception, match="broken"):
        B.publish_if_complete(broken, every, path)
    assert {v for _, v in published(spark, path)} == {"old"}
    time.sleep(2)  # a task that was still at work when the write was given up may have left a file that no version names
    assert B.remove_superseded(spark, path, older_than_s=0) == [] and sorted(str(p) for p in (tmp_path / "out").rglob("*")) == there


def test_publishers_at_once_and_removal(spark, tmp_path):
    path = str(tmp_path / "out")
    sets = [range(0, 10), range(5, 15), range(10, 20)]

    def publish(k):
        every = spark.createDataFrame([(i, True) for i in sets[k]], "script_id long, complete boolean")
        B.publish_if_complete(every.select("script_id", F.lit(k).alias("v")), every, path)

    publish(0)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(publish, [0, 1, 2]))
    files = sorted(p.name for p in (tmp_path / "out" / "_versions").iterdir())
    assert files == [f"{n:010d}.json" for n in (1, 2, 3, 4)]
    found = published(spark, path)
    assert len(found) == 20 and all(i in sets[v] for i, v in found) and {v for i, v in found if i < 5} == {0} and {v for i, v in found if i > 14} == {2}
    (tmp_path / "out" / "write-lost").mkdir()
    (tmp_path / "out" / "write-lost" / "part-1.parquet").write_bytes(b"half a file")
    assert published(spark, path) == found and B.remove_superseded(spark, path) == []
    gone = B.remove_superseded(spark, path, older_than_s=0)
    assert 1 in gone and published(spark, path) == found and not (tmp_path / "out" / "write-lost").exists()


RECEIPT = "event_id long, segment_id string, fingerprint string, finish_reason string, status int, content string, reply string"


def receipts(spark, rows):
    """(event_id, segment, finish_reason, covered) as receipts, an hour apart."""
    rows = [(i, s, "fp", reason, 200, "x", '{"segment": "%s", "covered": %s}' % (s, covered)) for i, s, reason, covered in rows]
    return spark.createDataFrame(rows, RECEIPT).withColumn("ts", F.timestamp_seconds(F.col("event_id") * 3600))


BATCHES = [
    [(1, "S1", "length", '["U1"]'), (2, "S2", "stop", '["U1"]'), (3, "S2", "stop", '["U1"]'), (4, "S3", "stop", '["U1", "U1"]'), (5, "S5", "stop", '["U1"')],
    [(6, "S1", "stop", '["U1"]'), (7, "S2", "stop", '["U1"]'), (8, "S3", "stop", '["U9"]')],
    [(9, "S1", "stop", '["U1"]'), (10, "S3", "stop", '["U1"]'), (11, "S4", "stop", '["U1"]')],
]


@pytest.mark.parametrize("at_once", [True, False])
def test_stream_commits_the_first_good_receipt_once(spark, tmp_path, at_once):
    expected = spark.createDataFrame([(f"S{i}", "U1") for i in (1, 2, 3, 5)], "segment_id string, unit_id string")
    schema = receipts(spark, BATCHES[0]).schema
    for rows in [sum(BATCHES, []), []] if at_once else [*BATCHES, []]:  # each is a run of its own, the last has nothing to read
        if rows:
            receipts(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = W.read_receipts(spark, str(tmp_path / "in"), schema)
        W.commit_segments(stream, str(tmp_path / "out"), str(tmp_path / "progress"), expected).awaitTermination()
    found = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.segment_id, r.event_id) for r in found) == [("S1", 6), ("S2", 2), ("S3", 10)]


def test_dedupe_counts_what_was_sent(spark, tmp_path):
    receipts(spark, BATCHES[0]).write.parquet(str(tmp_path / "in"))
    stream = W.dedupe_stream(W.read_receipts(spark, str(tmp_path / "in"), receipts(spark, BATCHES[0]).schema))
    stream.writeStream.format("memory").queryName("sent").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.segment_id for r in spark.table("sent").collect()) == ["S1", "S2", "S3", "S5"]


EVENT = "segment_id string, event_id long, kind string, missing int, ts timestamp"


def events(spark, rows):
    """(segment, event_id, kind, missing); event i is in hour i, or without a time if negative."""
    out = spark.createDataFrame([(s, i, k, m, None) for s, i, k, m in rows], EVENT)
    return out.withColumn("ts", F.when(F.col("event_id") >= 0, F.timestamp_seconds((F.col("event_id") + 1000) * 3600)))


def test_states_agree_with_the_batch_twin_for_every_order(spark, tmp_path):
    orders = [o for n in range(1, 4) for o in itertools.product([0, 1, None], repeat=n)]
    rows = [(f"R{k}", i, "audit", m) for k, order in enumerate(orders) for i, m in enumerate(order)]
    for i in range(3):  # a batch for each round, in a query that starts anew
        events(spark, [r for r in rows if r[1] == i]).write.mode("append").parquet(str(tmp_path / "in"))
        W.write_states(W.segment_states(W.read_receipts(spark, str(tmp_path / "in"), EVENT)), str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    apart = {r.segment_id: (r.state, r.rounds) for r in W.latest_states(spark, str(tmp_path / "out")).collect()}
    W.write_states(W.segment_states(W.read_receipts(spark, str(tmp_path / "in"), EVENT)), str(tmp_path / "out2"), str(tmp_path / "p2")).awaitTermination()
    together = {r.segment_id: (r.state, r.rounds) for r in W.latest_states(spark, str(tmp_path / "out2")).collect()}
    twin = V.audit_rounds(events(spark, rows).withColumnRenamed("event_id", "round"))
    expected = {r.segment_id: ({"pending": "audited"}.get(r.state, r.state), r.rounds) for r in twin.collect()}
    assert apart == together == expected
    named = {order: expected[f"R{k}"] for k, order in enumerate(orders)}
    assert named[1, 1, 0] == ("failed", 2) and named[0, 1] == ("done", 1) and named[1, 0] == ("done", 2) and named[1,] == ("audited", 1) and named[None, 1] == ("failed", 2)


def test_stalled_segments_fail_and_ended_ones_stay(spark, tmp_path):
    first = [("A", 0, "extracted", None), ("B", 0, "audit", 1), ("C", 1, "extracted", None), ("D", 1, "audit", 1), ("E", 1, "other", None), ("F", -1, "audit", 1), ("Z", 10, "audit", 0)]
    initial = spark.createDataFrame([("B", "audited", 1), ("D", "done", 1), ("G", "extracted", 0)], "segment_id string, state string, rounds int")
    for rows in (first, [("A", 20, "audit", 0), ("C", 20, "audit", 1), ("Y", 21, "audit", 0)]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        states = W.segment_states(W.read_receipts(spark, str(tmp_path / "in"), EVENT), stall=timedelta(hours=9, minutes=30), initial=initial)
        W.write_states(states, str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    found = {r.segment_id: (r.state, r.rounds, r.reason) for r in W.latest_states(spark, str(tmp_path / "out")).collect()}
    assert found == {
        "A": ("failed", 0, "stalled"), "B": ("failed", 2, "missing"), "C": ("audited", 1, None), "E": ("failed", 0, "stalled"), "F": ("audited", 1, None), "Y": ("done", 1, None), "Z": ("done", 1, None),
    }
