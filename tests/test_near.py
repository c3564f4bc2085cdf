import math
import random

from haatgrid.operators.near import near_pairs


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, x)))


def brute(points, r):
    ok = [(i, a, o) for i, a, o in points if a is not None and o is not None and -90 <= a <= 90 and -180 <= o <= 180 and (a, o) != (0, 0)]
    return {(min(i, j), max(i, j)) for n, (i, a, o) in enumerate(ok) for j, b, p in ok[n + 1 :] if i != j and km((a, o), (b, p)) <= r}


def check(spark, points, r):
    df = spark.createDataFrame(points, "id string, lat double, lon double")
    got = [(x["id_a"], x["id_b"]) for x in near_pairs(df, "id", "lat", "lon", r).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(points, r)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    pts = [(f"m{i:03}", 20 + rnd.gauss(0, 0.05), 75 + rnd.gauss(0, 0.05)) for i in range(150)]
    pts += [(f"s{i}", 20.01, 75.01) for i in range(5)]
    check(spark, pts, 2.5)


def test_poles_and_date_line(spark):
    rnd = random.Random(2)
    pts = [(f"n{i:02}", 90 - rnd.random() * 0.03, rnd.uniform(-180, 180)) for i in range(40)] + [("pole", 90.0, 12.0), ("south", -90.0, 0.0), ("south2", -89.99, 100.0)]
    pts += [(f"d{i:02}", 10 + rnd.random() * 0.02, 179.99 + rnd.random() * 0.01) for i in range(10)] + [(f"e{i:02}", 10 + rnd.random() * 0.02, -180 + rnd.random() * 0.01) for i in range(10)] + [("x", 10.0, 180.0), ("y", 10.0, -180.0)]
    check(spark, pts, 2.5)


def test_bad_coordinates_are_in_no_pair(spark):
    pts = [("a", None, 1.0), ("b", 1.0, None), ("c", 0.0, 0.0), ("d", 0.0, 0.0), ("e", 95.0, 1.0), ("f", 95.0, 1.0), ("g", 1.0, 686.0), ("h", 1.0, 1.0), ("i", 1.0, 1.0)]
    check(spark, pts, 2.5)
    assert near_pairs(spark.createDataFrame([], "id string, lat double, lon double"), "id", "lat", "lon", 1.0).count() == 0


def test_places_with_points_against_brute_force(spark):
    import math
    import random

    from haatgrid.operators.near import near_join

    rnd = random.Random(4)
    spot = lambda: (rnd.choice((rnd.uniform(-90, 90), rnd.uniform(20, 21), 89.9)), rnd.choice((rnd.uniform(-180, 180), rnd.uniform(70, 71), 180.0)))
    places, points = [(f"a{i}", *spot()) for i in range(60)] + [("none", None, 3.0)], [(f"b{i}", *spot()) for i in range(80)] + [("zero", 0.0, 0.0)]

    def km(p, q):
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    want = {(p[0], q[0]) for p in places[:-1] for q in points[:-1] if km(p, q) <= 50}
    got = near_join(spark.createDataFrame(places, "place string, lat double, lon double"), spark.createDataFrame(points, "point string, lat double, lon double"), 50.0)
    assert {(r["place"], r["point"]) for r in got.collect()} == want and want
