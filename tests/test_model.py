"""Random mutations against a plain row store."""

import random

from colonnade.session import Session


class Model:
    """Rows by key, static cells by partition; absent cells are missing."""

    def __init__(self):
        self.rows, self.statics = {}, {}

    def drop_empty(self, k):
        if not any(key[0] == k for key in self.rows):
            self.statics.pop(k, None)


def step(rng, model):
    k, c, v = rng.randrange(3), rng.randrange(4), rng.randrange(9)
    kind = rng.choice(["insert", "null", "static", "append", "prepend", "minus", "union", "put", "drop", "row", "range", "partition", "column", "index"])
    if kind == "static":
        model.statics.setdefault(k, {})["s"] = v
        return f"UPDATE w.t SET s = {v} WHERE k = {k}"
    if kind in ("row", "range", "partition"):
        keep = {"row": lambda key: key != (k, c), "range": lambda key: key[0] != k or key[1] < c, "partition": lambda key: key[0] != k}[kind]
        lost = {key for key in model.rows if not keep(key)}
        model.rows = {key: r for key, r in model.rows.items() if keep(key)}
        if kind == "partition":
            model.statics.pop(k, None)
        elif lost:
            model.drop_empty(k)
        return {"row": f"DELETE FROM w.t WHERE k = {k} AND c = {c}", "range": f"DELETE FROM w.t WHERE k = {k} AND c >= {c}", "partition": f"DELETE FROM w.t WHERE k = {k}"}[kind]
    if kind == "column":
        model.rows.get((k, c), {}).pop("v", None)
        return f"DELETE v FROM w.t WHERE k = {k} AND c = {c}"
    if kind == "index":
        row = model.rows.get((k, c), {})
        if "l" in row and v < len(row["l"]):
            row["l"] = row["l"][:v] + row["l"][v + 1 :]
            if not row["l"]:
                del row["l"]
        return f"DELETE l[{v}] FROM w.t WHERE k = {k} AND c = {c}"
    row = model.rows.setdefault((k, c), {})
    where = f"WHERE k = {k} AND c = {c}"

    def keep(name, value):
        if value:
            row[name] = value
        else:
            row.pop(name, None)

    if kind == "insert":
        row["v"] = v
        return f"INSERT INTO w.t (k, c, v) VALUES ({k}, {c}, {v})"
    if kind == "null":
        row.pop("v", None)
        return f"INSERT INTO w.t (k, c, v) VALUES ({k}, {c}, null)"
    if kind == "append":
        keep("l", row.get("l", []) + [v, v + 1])
        return f"UPDATE w.t SET l = l + [{v}, {v + 1}] {where}"
    if kind == "prepend":
        keep("l", [v] + row.get("l", []))
        return f"UPDATE w.t SET l = [{v}] + l {where}"
    if kind == "minus":
        keep("l", [x for x in row.get("l", []) if x != v])
        return f"UPDATE w.t SET l = l - [{v}] {where}"
    if kind == "union":
        keep("z", sorted({*row.get("z", []), v}))
        return f"UPDATE w.t SET z = z + {{{v}}} {where}"
    if kind == "put":
        row["m"] = {**row.get("m", {}), v: c}
        return f"UPDATE w.t SET m[{v}] = {c} {where}"
    keep("m", {a: b for a, b in row.get("m", {}).items() if a != v})
    return f"UPDATE w.t SET m = m - {{{v}}} {where}"


def wanted(model):
    out = {}
    for (k, c), r in model.rows.items():
        out[k, c] = (model.statics.get(k, {}).get("s"), r.get("v"), r.get("l"), r.get("z"), r.get("m"))
    for k, s in model.statics.items():
        if not any(key[0] == k for key in model.rows):
            out[k, None] = (s["s"], None, None, None, None)
    return out


def test_random_mutations(spark):
    rng, model, db = random.Random(11), Model(), Session(spark)
    db.execute("CREATE KEYSPACE w")
    db.execute("CREATE TABLE w.t (k int, c int, v int, l list<int>, z set<int>, m map<int, int>, s int STATIC, PRIMARY KEY (k, c))")
    for _ in range(6):
        for _ in range(25):
            db.execute(step(rng, model))
        got = {(r.k, r.c): (r.s, r.v, r.l, r.z, r.m) for r in db.execute("SELECT * FROM w.t").collect()}
        assert got == wanted(model)
