"""Batches merged into stored entities against the rule row by row; a rerun changes nothing; versions stand whole or not."""

import math

import pytest

from wayloom.operators.upsert import Versions, upserted
from wayloom.plans import catalog
from wayloom.plans.persistence import observed, stored
from wayloom.sources.shared import Tables


def metres(a, b):
    la, lo, lb, ob = map(math.radians, (a["latitude"], a["longitude"], b["latitude"], b["longitude"]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def same(a, b):
    x, y = (" ".join(r["name"].lower().replace("é", "e").split()) for r in (a, b))
    placed = None not in (a["latitude"], b["latitude"])
    return a["kind"] == b["kind"] and placed and (x in y or y in x) and metres(a, b) <= 150


def plain(entities, identities, batch):
    """Rows one after the other against the tables as they were; new ones against those created before."""
    owner, out, taken = dict(identities), {}, {}
    batch = sorted(batch, key=lambda r: r["seq"])
    open_ = []
    for r in batch:
        owners = {owner[i] for i in r["ids"] if i in owner}
        if owners:
            out[r["seq"]] = ("UPDATE", min(owners)) if len(owners) == 1 else ("CONFLICT", None)
            continue
        open_.append(r)
        near = [(metres(r, e), k) for k, e in entities.items() if same(r, e)]
        for i in r["ids"] if near else ():
            taken.setdefault(i, min(near)[1])
    left, new, top = [], [], max(entities)
    for r in open_:
        owners = {taken[i] for i in r["ids"] if i in taken}
        if owners:
            out[r["seq"]] = ("ATTACHED", min(owners)) if len(owners) == 1 else ("CONFLICT", None)
        else:
            left.append(r)
    unit = {r["seq"]: r["seq"] for r in left}
    moved = True
    while moved:
        moved = False
        for a in left:
            for b in left if len(a["ids"]) > 1 else ():
                if set(a["ids"]) & set(b["ids"]) and unit[a["seq"]] != unit[b["seq"]]:
                    unit[a["seq"]] = unit[b["seq"]] = min(unit[a["seq"]], unit[b["seq"]])
                    moved = True
        lead = {}
        for r in left:
            for i in r["ids"]:
                low = min(lead.get(i, r["seq"]), unit[r["seq"]])
                moved |= unit[r["seq"]] != low
                lead[i] = unit[r["seq"]] = low
    for r in left:
        if unit[r["seq"]] != r["seq"]:
            out[r["seq"]] = ("JOINED", out[unit[r["seq"]]][1])
            continue
        met = [n for n in new if same(r, n)]
        if met:
            out[r["seq"]] = ("JOINED", out[met[0]["seq"]][1])
        else:
            top += 1
            out[r["seq"]] = ("CREATED", top)
            new.append(r)
    for r in batch:
        k = out[r["seq"]][1]
        if k is not None:
            entities[k] = {f: r[f] for f in ("name", "kind", "latitude", "longitude")}
            for i in r["ids"]:
                owner.setdefault(i, k)
    return out, entities, owner


@pytest.fixture(scope="module")
def inputs(spark):
    sf = "/root/testdata/sf0.01"
    entities, identities = stored(spark, sf)
    return sf, {r.entity_id: r.asDict() for r in entities.collect()}, [(r.id, r.entity_id) for r in identities.collect()], [r.asDict() for r in observed(spark, sf).collect()]


def test_outcomes_equal_the_rule(spark, inputs):
    sf, entities, identities, batch = inputs
    out, held, owner = plain(dict(entities), identities, batch)
    got = {r.seq: (r.outcome, r.entity_id) for r in catalog.QUERIES["op_er_23_entity_upsert"](spark, sf).collect()}
    assert got == out and {o for o, _ in out.values()} == {"UPDATE", "CONFLICT", "ATTACHED", "CREATED", "JOINED"}
    rows = {r.entity_id: (r.name, r.kind, r.latitude, r.longitude, r.n_ids) for r in catalog.QUERIES["op_er_24_persisted_entities"](spark, sf).collect()}
    rounded = lambda v: None if v is None else round(v, 6)
    assert rows == {k: (e["name"], e["kind"], rounded(e["latitude"]), rounded(e["longitude"]), sum(x == k for x in owner.values())) for k, e in held.items()}


def test_a_rerun_changes_nothing_and_versions_stand_whole(spark, inputs, tmp_path):
    sf, tables = inputs[0], Tables(spark, "t")
    store = Versions(spark, str(tmp_path / "store"))
    entities, identities = stored(spark, sf)
    assert store.last() == 0 and store.write({"entity": entities, "identity": identities}) == 1
    seen = []
    for version in (2, 3):
        e, i, out = upserted(store.read("entity"), store.read("identity"), observed(spark, sf), tables)
        assert store.write({"entity": e, "identity": i}) == version
        seen.append((sorted(tuple(r) for r in store.read("identity").collect()), sorted((tuple(r) for r in store.read("entity").select("entity_id", "name", "kind", "latitude", "longitude").collect()), key=str)))
        kinds = {r.outcome for r in out.collect()}
    assert seen[0] == seen[1] and kinds <= {"UPDATE", "CONFLICT"}
    # A writer that dies before its mark leaves the last version as it is.
    store.read("entity").limit(1).write.parquet(str(tmp_path / "store" / "v4" / "entity"))
    assert store.last() == 3 and len(seen[1][1]) == store.read("entity").count()
    empty = observed(spark, sf).limit(0)
    assert upserted(entities, identities, empty, tables)[0].count() == entities.count()
    tables.close()
