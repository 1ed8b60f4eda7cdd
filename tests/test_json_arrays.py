"""Array files cut at any byte give the records that a whole read gives."""

from __future__ import annotations

import json
import random

import pytest

from perkline.sources import files, json_arrays

TEXTS = ["plain", "", 'quote " inside', "back\\slash", "ends with \\", "[{]}", '"offers": [', "naïve – ünï", "\\\\\"", "line\nbreak"]


def _value(r: random.Random, depth: int = 0):
    kind = r.randrange(6 if depth < 3 else 4)
    if kind == 0:
        return r.choice(TEXTS)
    if kind == 1:
        return r.randrange(-5, 5)
    if kind == 2:
        return None
    if kind == 3:
        return r.random() < 0.5
    if kind == 4:
        return [_value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(TEXTS): _value(r, depth + 1) for _ in range(r.randrange(4))}


def _record(r: random.Random, i: int) -> dict:
    return {"id": i, "x": _value(r), "offers": [{"id": -1}], "y": {"z": _value(r)}}


def _write(folder, seed: int) -> dict[str, list]:
    r = random.Random(seed)
    want = {}
    for f in range(4):
        rows = [_record(r, i) for i in range(r.randrange(12))]
        style = {"indent": r.choice([None, 1, 4]), "ensure_ascii": r.random() < 0.5}
        if f % 2:
            text = json.dumps({"meta": {"offers": [{"id": -2}]}, "old": [{"id": -3}], "offers": rows, "new": [{"id": -4}, [{"id": -5}]]}, **style)
        else:
            mixed = [x for row in rows for x in (row, r.choice([1, "t{", None, [{"id": -6}]]))]
            text = json.dumps(mixed, **style)
        (folder / f"f{f}.json").write_text("  \n" * (f == 2) + text, encoding="utf-8")
        want[f"f{f}.json"] = rows
    return want


@pytest.mark.parametrize("slice_bytes", [3, 64, None])
def test_records_of_slices_equal_a_whole_read(spark, tmp_path, slice_bytes):
    want = _write(tmp_path, slice_bytes or 0)
    got: dict[str, list] = {}
    for row in json_arrays.records(spark, str(tmp_path), slice_bytes=slice_bytes).orderBy("path", "position").collect():
        got.setdefault(row["path"].rsplit("/", 1)[1], []).append(json.loads(row["record"]))
    assert got == {k: v for k, v in want.items() if v}


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    rows = [{"id": i, "t": "x" * (i % 300)} for i in range(5000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    size = (tmp_path / "a.json").stat().st_size
    cut = json_arrays.slices(spark, str(tmp_path)).collect()
    assert len(cut) >= 4 and sum(r["stop"] - r["start"] for r in cut) == size
    d = files.read_offer_arrays(spark, str(tmp_path), "id long, t string")
    assert d.agg({"id": "sum"}).first()[0] == sum(r["id"] for r in rows) and d.count() == 5000
    assert json_arrays.records(spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_files_without_records(spark, tmp_path):
    texts = ["", " \n", "[]", "{}", "3", '"[{"', '{"offers": {"id": 1}}', '{"other": [{"id": 1}]}', "[1, 2]", '[{"id": 1']
    for i, text in enumerate(texts):
        (tmp_path / f"a{i}.json").write_text(text)
    assert json_arrays.records(spark, str(tmp_path), slice_bytes=2).count() == 0


def test_the_last_of_repeated_keys_counts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"offers": [{"id": 1}], "offers" : [{"id": 2}, {"id": "]"}], "n": []}')
    found = json_arrays.records(spark, str(tmp_path), slice_bytes=5).orderBy("position").collect()
    assert [json.loads(r["record"])["id"] for r in found] == [2, "]"]
