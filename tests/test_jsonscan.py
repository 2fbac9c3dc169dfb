"""GeoJSON files cut at feature borders, against the standard parser and the whole-document reader."""

import json
import random

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from slidelake.sources import geojson
from slidelake.sources.jsonscan import Scan, array_elements

NASTY = ["", "}", "]", "[{", ",", '"', "\\", '\\"', '\\\\', "\\\\\"],{", "ü€𝄞", "a\nb", '"features":[', " "]


def nested(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind == 4:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {rng.choice(NASTY) + str(i): nested(rng, depth + 1) for i in range(rng.randrange(4))}
    return [None, rng.randrange(-9, 99), rng.choice(NASTY) * rng.randrange(4), rng.random() < 0.5][kind]


def document(rng, elements):
    root = {rng.choice(NASTY) + str(i): nested(rng) for i in range(rng.randrange(4))}
    members = list(root.items()) + [("features", elements)]
    rng.shuffle(members)
    return json.dumps(dict(members), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))


def naive(text, in_string, escaped):
    """Marks outside strings by one automaton over the bytes."""
    at = []
    for i, c in enumerate(text):
        if escaped:
            escaped = 0
            if c == ord('"'):
                continue
        elif c == ord("\\"):
            escaped = 1
            continue
        elif c == ord('"'):
            in_string ^= 1
            continue
        if not in_string and c in b"{}[],":
            at.append(i)
    return at, in_string, escaped


def test_scan_equals_the_automaton_from_every_start():
    rng = random.Random(5)
    for _ in range(400):
        text = bytes(rng.choice(b'\\\\\\""{}[],ab') for _ in range(rng.randrange(30)))
        for k in range(4):
            scan = Scan(np.frombuffer(text, np.uint8), k & 1, k >> 1)
            assert (list(scan.at), scan.in_string, scan.escaped) == naive(text, k & 1, k >> 1), (text, k)


@pytest.mark.parametrize("chunk_bytes", [1, 7, 64, 1 << 20])
def test_elements_equal_the_parser(spark, folder, chunk_bytes):
    rng = random.Random(chunk_bytes)
    want, files = [], []
    for i in range(6):
        elements = [nested(rng) for _ in range(rng.choice([0, 1, 2, 9]))]
        text = document(rng, elements).encode()[: 900 if chunk_bytes == 1 else None]
        with open(f"{folder}/{i}.json", "wb") as out:
            out.write(text)
        files.append((f"file:{folder}/{i}.json", len(text)))
        try:
            want += [(f"{i}.json", p, json.dumps(e)) for p, e in enumerate(json.loads(text)["features"])]
        except ValueError:
            want.append((f"{i}.json", None, "malformed JSON"))
    found, broken = array_elements(spark.createDataFrame(files, "path string, length bigint"), "features", chunk_bytes=chunk_bytes)
    got = [(r.path.rpartition("/")[2], r.pos, json.dumps(json.loads(r.element))) for r in found.collect()]
    got += [(r.path.rpartition("/")[2], None, r.reason) for r in broken.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_broken_documents(spark, folder):
    texts = {
        "empty": "", "blank": " \n", "list": '[{"features": []}]', "open": '{"features": [1, 2', "string": '{"features": ["a]}',
        "two": '{"features": []}{"features": []}', "tail": '{"features": []},', "crossed": '{"features": [1}}', "none": '{"a": {"features": [1]}}',
        "null": '{"features": null, "a": [1]}', "object": '{"features": {"a": [1, 2]}}', "twice": '{"features": [1], "features": [2]}', "hole": '{"features": [1,,2]}',
    }
    for name, text in texts.items():
        with open(f"{folder}/{name}", "w") as out:
            out.write(text)
    files = spark.createDataFrame([(f"{folder}/{n}", len(t)) for n, t in texts.items()], "path string, length bigint")
    found, broken = array_elements(files, "features", chunk_bytes=4)
    last = F.element_at(F.split("path", "/"), -1)
    assert rows(found.withColumn("name", last), "name", "pos", "element") == [("hole", 0, "1"), ("hole", 1, ""), ("hole", 2, "2"), ("twice", 0, "1")]
    wrong = {n: r for n, r in rows(broken.withColumn("name", last), "name", "reason")}
    assert wrong == dict.fromkeys(["empty", "blank", "list", "open", "string", "two", "tail", "crossed"], "malformed JSON") | {"none": "missing features"}


def test_split_files_read_as_whole_ones(spark, folder):
    def feature(i):
        if i % 7 == 3:
            return {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": "none"}}
        name = {"id": f"a{i}"} if i % 3 else {}
        return {"type": "Feature", **name, "geometry": {"type": "Point", "coordinates": [i, i / 2]}, "properties": {"label": NASTY[i % len(NASTY)], "n": i}}

    for slide, n in (("s 1", 120), ("s2", 0), ("s3", 33)):
        with open(f"{folder}/{slide}.geojson", "w") as out:
            json.dump({"type": "FeatureCollection", "bbox": [0, 1, 2, 3], "first_position": n, "features": [feature(i) for i in range(n)]}, out)
    with open(f"{folder}/bad.geojson", "w") as out:
        out.write("{oops" * 900)
    whole, split = (geojson.read_annotations(spark, folder, *sizes) for sizes in ((1 << 30,), (3000, 500)))
    shown = ("slide_id", "pos", "annotation_id", "type", "coordinates", "labels")
    a, b = (rows(df.withColumn("labels", F.col("properties")["label"]).na.fill(""), *shown) for df in (whole[0], split[0]))
    assert len(a) == 131 and a == b
    assert rows(whole[1], "path", "slide_id", "pos", "reason") == rows(split[1], "path", "slide_id", "pos", "reason")
