"""Operators against small cases and brute force."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from isoline.functions import colors, geometry, measures, tags
from isoline.operators import filters, greedy, grouping, linelist, propagation, spatial
from isoline.operators.graph import connected_components
from isoline.sources import linelists
from isoline.streaming import progress


def test_tags_normalise_match_parse(spark):
    rows = [('695-6"-gf-ccb-026',), ("650 - 1' - L0 - CPA - O19",), ("14-P2-1802-A1A2-6”-H-50",), ("650-V-202A",), (None,)]
    df = spark.createDataFrame(rows, "raw string").withColumn("n", tags.normalise(F.col("raw"))).withColumn("m", tags.match(F.col("n")))
    got = [(r.n, r.m and r.m.pid, r.m and r.m.weight) for r in df.collect()]
    assert got[0] == ('695-6"-GF-CCB-026', '695-6"-GF-CCB-026', 3)
    assert got[1][2] == 1 and "-LO-CPA-019" in got[1][1]
    assert got[2][1].startswith("14-P2-1802-A1A2-6") and got[2][2] == 3
    assert got[3][1] is None and got[4][0] is None


def test_learned_schema(spark):
    empty = spark.createDataFrame([], "n_tokens int, field string, idx int")
    learned = tags.teach(empty, "X1-GAS-77-QQ-9", {"fluid": 1, "pclass": 3, "seq": 4})
    df = spark.createDataFrame([("A2-OIL-11-ZZ-5",), ("A2-OIL",), ('695-6"-GF-CCB-026',)], "pid string")
    got = {r.pid: (r.fluid, r.pclass, r.seq) for r in tags.parse_learned(df, learned).collect()}
    assert got == {"A2-OIL-11-ZZ-5": ("OIL", "ZZ", "5"), "A2-OIL": ("", "", ""), '695-6"-GF-CCB-026': ("GF", "CCB", "026")}


def test_measures(spark):
    rows = [("18.4 barg",), ("120.5 °C",), ("-",), ("N/A",), ("1,234.5",), ("1e5",), (".5 kg",), ("about 3",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(measures.number(F.col("c"))).collect()]
    assert got == [18.4, 120.5, None, None, 1.234, 1.0, 0.5, None, None]


def test_line_list_csv_and_mapping(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Piping ID,Oprt. Press,Oprt. Temp,Phase,Corr. Loop,Matl\n605-1,15.2 barg,92.5,liq,CL-1,ss\n605-2,-,N/A,STEAM,,\n,1,2,L,,\n605-3,1,2,mixed,,cs\n")
    got = {r.line_number: r for r in linelists.read_line_list(spark, str(tmp_path / "a.csv")).collect()}
    assert set(got) == {"605-1", "605-2", "605-3"}
    assert (got["605-1"].operating_pressure_barg, got["605-1"].operating_temperature_c, got["605-1"].material) == (15.2, 92.5, "SS")
    assert [got[k].fluid_phase for k in sorted(got)] == ["L", "G", "2P"] and got["605-2"].operating_pressure_barg is None
    (tmp_path / "b.csv").write_bytes("Nomor Jalur,Fasa\nA-1 é,Steam\n".encode("latin-1"))
    entry = linelists.read_csv(spark, str(tmp_path / "b.csv"), {"Nomor Jalur": "line_number", "fluid_phase": "Fasa"}).first()
    assert (entry.line_number, entry.fluid_phase) == ("A-1 é", "G")
    with pytest.raises(ValueError):
        linelist.parse_rows(spark.createDataFrame([("x",)], "remarks string"))
    # a folder: every file has its own header and encoding, rows keep their number, unmapped cells stay
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "a.csv").write_text('Tag,Op Temp (C),Colour\nL-1,10,"red, dark"\nL-2,,\nL-1,12,blue\n', encoding="utf-8")
    (tmp_path / "lists" / "b.csv").write_bytes("Colour,Line Number,Phase\nvert é,L-9,Gas\n".encode("latin-1"))
    got = linelists.read_csv(spark, str(tmp_path / "lists"))
    rows = sorted((r.source.rsplit("/", 1)[1], r.row_no, r.line_number, r.operating_temperature_c, r.fluid_phase, r.raw_attributes.get("Colour")) for r in got.collect())
    assert rows == [("a.csv", 1, "L-1", 10.0, "", "red, dark"), ("a.csv", 2, "L-2", None, "", None), ("a.csv", 3, "L-1", 12.0, "", "blue"), ("b.csv", 1, "L-9", None, "G", "vert é")]
    merged = linelist.merge_entries(got, "row_no").collect()
    assert {(r.line_number, r.operating_temperature_c, r.n_rows) for r in merged} == {("L-1", 10.0, 2), ("L-2", None, 1), ("L-9", None, 1)}
    assert linelist.match_columns(["X", "Y"], {"X": "piping id", "op_temp": "y"}) == {"line_number": "X", "operating_temperature_c": "Y"}


def test_workbook(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [["Line No", "Phase"], ["L-1", "gas"], ["L-2", "liq"]]
    body = "".join("<row>" + "".join(cell(f"{'AB'[j]}{i + 1}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData><row>{cell('A1', 'only notes')}</row></sheetData></worksheet>")
    got = {(r.line_number, r.fluid_phase, r.row_no) for r in linelists.read_line_list(spark, str(tmp_path / "x.xlsx")).collect()}
    assert got == {("L-1", "G", 1), ("L-2", "L", 2)}
    (tmp_path / "x.xlsx").rename(tmp_path / "x.data")
    assert linelists.read_line_list(spark, str(tmp_path / "x.data")).count() == 2


def test_other_sources(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    (tmp_path / "truth").mkdir()
    table = [["Source File", "Piping ID", "Color Group", "Other"], ["D-1", '605-6"-gf', "red", "x"], ["D-1", "605-6-GF", "blue", ""], ["D-2", "A--1", "nan", ""], ["nan", "B", "red", ""]]
    body = "".join("<row>" + "".join(f'<c r="{"ABCD"[j]}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(table))
    with zipfile.ZipFile(tmp_path / "truth" / "a_loop_dataset.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    (tmp_path / "truth" / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "truth" / "~$a_loop_dataset.xlsx").write_bytes(b"lock")
    assert [tuple(r) for r in linelists.read_ground_truth(spark, str(tmp_path / "truth")).collect()] == [("D-1", "605-6-GF", "blue")]
    (tmp_path / "spec.json").write_text('{"classes": {"cda": {"material": "ss", "name": "x", "design_pressure_barg": 19.6}}}')
    assert [tuple(r)[:4] for r in linelists.read_material_spec(spark, str(tmp_path / "spec.json")).collect()] == [("CDA", "SS", "x", 19.6)]
    (tmp_path / "map.csv").write_text("\ufeffpiping_class,material\nasa , cs\n,x\nB1,\n", encoding="utf-8")
    assert [tuple(r) for r in linelists.read_class_map(spark, str(tmp_path / "map.csv")).collect()] == [("ASA", "CS")]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "p1.txt").write_text("0 0.5 0.5 0.1 0.2\nnot a label\n2 0.1 0.2 0.3\n")
    assert [(r.stem, r.cls, r.h) for r in linelists.read_yolo_labels(spark, str(tmp_path / "labels")).collect()] == [("p1", 0, 0.2)]
    (tmp_path / "log.csv").write_text("epoch,  map50\n2, 0.5\n10, 0.7\n9, 0.6\n")
    assert [r.map50 for r in linelists.read_training_log(spark, str(tmp_path / "log.csv")).collect()] == ["0.7"]
    docs = spark.createDataFrame([("s1", [{"pid": "A-1", "run_idx": 3}]), ("s2", [])], "sheet_id string, piping_ids array<struct<pid:string,run_idx:int>>")
    for _ in range(2):
        linelists.save_results(docs, str(tmp_path / "results"))
    linelists.save_results(docs.where("sheet_id = 's2'"), str(tmp_path / "results"))
    found = linelists.read_results(spark, str(tmp_path / "results" / "*"))["piping_ids"].collect()
    assert [(r.idx, r.pid, r.run_idx) for r in found] == [(0, "A-1", 3)]
    caches = spark.createDataFrame([(1, 3, 0, 10, 20), (2, 3, 360, None, 20), (3, 2, 0, 10, 20), (4, 3, 90, 10, 20), (5, 3, None, 10, 21)], "id int, v int, rot int, w int, h int")
    assert sorted(r.id for r in linelists.valid_cache(caches, 3, 0, 10, 20).collect()) == [1, 2]
    files = spark.createDataFrame([("p/a.PDF", 2), ("p/b.pdf", 1), ("p/c.png", 5)], "path string, n_pages int")
    assert [(r.page_path, r.sheet_number) for r in linelists.page_sheets(files).orderBy("path", "page").collect()] == [("p/a-p001.pdf", "1/2"), ("p/a-p002.pdf", "2/2"), ("p/b.pdf", ""), ("p/c.png", "")]


def test_material_and_phase_split(spark):
    cols = "sheet_id int, pid_idx int, pid string, fluid string, pclass string, run_id int, fluid_phase string, corrosion_loop string, material string, operating_temperature double, operating_pressure double, corrosion_allowance double"
    rows = [(1, i, p, "GR", c, i, ph, "", "", 10.0 + i, None, 3.0) for i, (p, c, ph) in enumerate([("a", "CCC", "L"), ("b", "CCC", "G"), ("c", "CDA", "L")])]
    t = spark.createDataFrame(rows, cols)
    got = grouping.circuits(grouping.direct_labels(t), t, grouping.material_spec(spark)).collect()
    assert len(got) == 3 and {(r.material, r.fluid_phase) for r in got} == {("CS", "L"), ("CS", "G"), ("SS", "L")}
    assert {r.code for r in got} == {"01.01", "01.02", "01.03"} and {r.rule for r in got} == {"API_RP_970_PHASE_BOUNDARY"}
    classes = spark.createDataFrame([("CDA", ""), ("CCC", None), ("DSE", " "), ("A4A2", ""), ("XQZ", ""), ("CDA", "titanium"), ("Z", "")], "pclass string, material string")
    got = [r.effective_material for r in grouping.with_material(classes, grouping.material_spec(spark)).collect()]
    assert sorted(got) == sorted(["SS", "CS", "SS", "SS", "Q", "TITANIUM", ""])


def _graph(seed: int, n: int = 40):
    r = random.Random(seed)
    return [(a, b) for a, b in {(min(p), max(p)) for p in ((r.randrange(n), r.randrange(n)) for _ in range(n))} if a != b], [r.randrange(1, 9) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    edges, _ = _graph(seed)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (99, 99), (None, 3)], "src int, dst int")).collect()}
    assert got == {x: root(x) for x in up} | {99: 99}
    chain = [(i, i + 1) for i in range(60)]
    assert {r.component for r in connected_components(spark.createDataFrame(chain, "src int, dst int")).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_propagation_matches_dijkstra(spark, seed):
    edges, cost = _graph(seed)
    seeds = [(0, 100), (7, 50), (7, 20), (13, 70)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start = {a: min(s for x, s in seeds if x == a) for a, _ in seeds}
    want, queue = {}, [(0.0, 0, s, a) for a, s in start.items()]
    heapq.heapify(queue)
    while queue:
        d, h, s, a = heapq.heappop(queue)
        if a not in want:
            want[a] = (s, d, h)
            for b in near.get(a, ()):
                if b not in want and b not in start:
                    heapq.heappush(queue, (d + cost[b], h + 1, s, b))
    runs = spark.createDataFrame([(1, k, float(c)) for k, c in enumerate(cost)], "sheet_id int, run_id long, length double")
    e = spark.createDataFrame([(1, a, b) for a, b in edges], "sheet_id int, a long, b long")
    s = spark.createDataFrame([(1, a, x) for a, x in seeds], "sheet_id int, run_id long, source long")
    for f in (propagation.propagate, propagation.propagate_by_sheet):
        got = {r.run_id: (r.source, r.dist, r.hops) for r in f(runs, e, s).collect()}
        assert got == want


def test_adjacency_blocked_and_row_order(spark):
    rows = [(1, 1, "H", 0, 0, 100, 0), (1, 2, "V", 103, 0, 103, 90), (1, 3, "H", 112, 90, 200, 90), (1, 4, "H", 500, 500, 600, 500)]
    runs = spark.createDataFrame(rows, "sheet_id int, run_id int, axis string, x1 int, y1 int, x2 int, y2 int")
    both = {(r.a, r.b) for r in spatial.adjacency(runs, 4.0, corner=12.0).collect()}
    assert both == {(1, 2), (2, 3)} == {(r.a, r.b) for r in spatial.adjacency(runs.repartition(3), 4.0, corner=12.0).collect()}
    cut = spark.createDataFrame([(1, 2, 1)], "sheet_id int, a int, b int")
    assert {(r.a, r.b) for r in spatial.adjacency(runs, 4.0, corner=12.0, blocked=cut).collect()} == {(2, 3)}


def test_tee_split(spark):
    rows = [(1, 1, "H", 0, 0, 100, 0), (1, 2, "V", 40, 0, 40, 50), (1, 3, "V", 70, -30, 70, 30), (1, 4, "V", 97, 1, 97, 30)]
    runs = spark.createDataFrame(rows, "sheet_id int, run_id int, axis string, x1 int, y1 int, x2 int, y2 int")
    got = [(r.lo, r.hi) for r in spatial.split_at_tees(runs, 3.0, 8).where("run_id = 1").orderBy("piece").collect()]
    assert got == [(0, 40), (40, 100)]  # a crossing cuts nothing, nor does a branch too near to the end


def _iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u else 0


def test_nms_matches_brute_force(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        x, y = r.randrange(100), r.randrange(100)
        rows.append((k % 2, k, x, y, x + r.randrange(5, 40), y + r.randrange(5, 40), r.random(), "valve"))
    df = spark.createDataFrame(rows, "sheet_id int, box_id int, x1 int, y1 int, x2 int, y2 int, score double, coarse string")
    want = set()
    for s in (0, 1):
        kept = []
        for b in sorted((b for b in rows if b[0] == s), key=lambda b: (-b[6], b[1])):
            if all(_iou(b[2:6], k[2:6]) <= 0.5 for k in kept):
                kept.append(b)
        want |= {b[1] for b in kept}
    assert {x.box_id for x in greedy.nms(df, 0.5).collect()} == want
    merged = greedy.merge_boxes(df, gap=0).collect()
    for a, b in itertools.combinations([m for m in merged if m.sheet_id == 0], 2):
        assert a.x2 < b.x1 or b.x2 < a.x1 or a.y2 < b.y1 or b.y2 < a.y1
    assert sum(m.n_boxes for m in merged) == 60
    hits = greedy.match_boxes(df, df.where("box_id % 3 = 0"), 0.5).collect()
    assert len(hits) == 20 and all(h.tp for h in hits)


def test_filters_keep_edits(spark):
    current = spark.createDataFrame([(1, 1, True, "", "old"), (1, 2, False, "", "old"), (1, 3, True, "mine", "old"), (1, 4, None, "", None)], "sheet_id int, run_id int, marked boolean, label string, pid string")
    found = spark.createDataFrame([(1, k, "new") for k in range(1, 5)], "sheet_id int, run_id int, pid string")
    got = {r.run_id: r.pid for r in filters.merge_enrichment(current, found).collect()}
    assert got == {1: "new", 2: "old", 3: "old", 4: None}


def test_geometry(spark):
    row = spark.range(1).select(geometry.length(F.expr("array(array(0, 0), array(3, 4), array(3, 10))")).alias("n"), geometry.length(F.expr("array(array(1, 1))")).alias("one"), geometry.point_segment(F.lit(5), F.lit(5), F.lit(0), F.lit(0), F.lit(10), F.lit(0)).alias("d"), geometry.point_segment(F.lit(3), F.lit(4), F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("p"), geometry.tile_offsets(F.lit(100), 40, 10).alias("t"), geometry.rotate(F.lit(1), F.lit(2), F.lit(90), F.lit(10), F.lit(20)).alias("r")).first()
    assert (row.n, row.one, row.d, row.p, row.t, tuple(row.r)) == (11.0, 0.0, 5.0, 5.0, [0, 30, 60], (17, 1))


def test_stream_of_job_states_equals_batch(spark, small, tmp_path):
    from isoline.plans.derive import derived

    events = derived(spark, small, "d_progress")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    query = progress.stream_job_state(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), str(tmp_path / "check"), str(tmp_path / "out"), 1)
    query.awaitTermination()
    got = {tuple(r) for r in progress.snapshot(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in progress.job_state(events).collect()} and query.lastProgress is not None


def _far(a, b):
    red = (a[0] + b[0]) / 2
    return ((2 + red / 256) * (a[0] - b[0]) ** 2 + 4 * (a[1] - b[1]) ** 2 + (2 + (255 - red) / 256) * (a[2] - b[2]) ** 2) ** 0.5


def test_colors_are_far_from_those_in_use(spark):
    known = {"GF": 3, "LO": 0}
    new = ["VRE", "GT", "GF", "", "AI", *(f"X{k}" for k in range(25))]
    pal, used = colors.palette(), dict(known)
    for f in new:
        if f and f not in used:
            free = [k for k in range(len(pal)) if k not in used.values()]
            away = {k: min(_far(pal[k], pal[u]) for u in used.values()) for k in free}
            plenty = [k for k in free if away[k] >= colors.ALIKE * colors.PLENTY]
            used[f] = plenty[0] if plenty else max(free, key=lambda k: (away[k], -k))
    fluids = spark.createDataFrame([(f, k) for k, f in enumerate(new)], "fluid string, place int")
    old = spark.createDataFrame(list(known.items()), "fluid string, n int")
    assert {r.fluid: r.n for r in colors.choose(fluids, old).collect()} == used and len(set(used.values())) == len(used)
    assert [r.n for r in colors.choose(fluids.where("fluid = 'AI'"), old.where("false")).collect()] == [0]
    moved = colors.recolour("GT", spark.createDataFrame(list(used.items()), "fluid string, n int")).first()
    rest = [pal[u] for f, u in used.items() if f != "GT"]
    assert min(_far(moved.color, u) for u in rest) >= max(min(_far(c, u) for u in rest) for c in colors.STRONG)


def test_merged_boxes_against_rounds(spark):
    r = random.Random(11)
    rows = []
    for k in range(50):
        x, y = r.randrange(140), r.randrange(140)
        rows.append((k % 2, k, x, y, x + r.randrange(5, 40), y + r.randrange(5, 40)))
    df = spark.createDataFrame(rows, "sheet_id int, box_id int, x1 int, y1 int, x2 int, y2 int")

    def meet(a, b, gap):
        if gap is not None:
            return a[0] - gap <= b[2] and b[0] - gap <= a[2] and a[1] - gap <= b[3] and b[1] - gap <= a[3]
        shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return shared / min((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)) > 0.25

    for gap in (None, 3):
        want = []
        for s in (0, 1):
            todo = [(*b[2:], 1) for b in rows if b[0] == s]
            while True:
                groups = [{k} for k in range(len(todo))]
                for a, b in itertools.combinations(range(len(todo)), 2):
                    if meet(todo[a], todo[b], gap):
                        one, two = (next(g for g in groups if k in g) for k in (a, b))
                        if one is not two:
                            one |= two
                            groups.remove(two)
                if len(groups) == len(todo):
                    break
                todo = [(min(todo[k][0] for k in g), min(todo[k][1] for k in g), max(todo[k][2] for k in g), max(todo[k][3] for k in g), sum(todo[k][4] for k in g)) for g in groups]
            want += [(s, *t) for t in todo]
        assert sorted(tuple(x) for x in greedy.merge_boxes(df, gap=gap).collect()) == sorted(want)


def test_components_end_exactly(spark):
    """A round is judged by its edges: chains, stars and rings of many sizes, each with its own smallest node."""
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200 + k, 200 + (k + 1) % 17) for k in range(17)] + [(500, 400), (400, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200 + k: 200 for k in range(17)} | {400: 400, 500: 400}


def test_conflicts_go_to_the_nearest(spark):
    from isoline.operators import association

    labels = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "A"), (1, 4, "C"), (1, 5, "D")], "sheet_id int, pid_idx long, pid string")
    picks = spark.createDataFrame([(1, 1, 10, 5.0), (1, 2, 10, 2.0), (1, 3, 11, 1.0), (1, 5, 12, 1.0)], "sheet_id int, pid_idx long, run_id long, cost double")
    leaders = spark.createDataFrame([(1, 1, 11, 0.9), (1, 1, 13, 0.5), (1, 4, 14, 0.7)], "sheet_id int, pid_idx long, run_id long, score double")
    got = {r.pid_idx: (r.run_id, r.state) for r in association.resolve(labels, picks, leaders).collect()}
    assert got == {1: (13, "leader"), 2: (10, "attached"), 3: (11, "attached"), 4: (14, "leader"), 5: (12, "attached")}


def test_tag_under_text(spark):
    from isoline.operators import association

    labels = spark.createDataFrame([(1, 1, 100, 100, 160, 112), (1, 2, 300, 100, 312, 160)], "sheet_id int, pid_idx long, x1 int, y1 int, x2 int, y2 int")
    runs = spark.createDataFrame([(1, 10, "H", 0, 90, 400, 90), (1, 11, "H", 90, 120, 400, 120), (1, 12, "V", 320, 0, 320, 400), (1, 13, "V", 140, 80, 140, 200)], "sheet_id int, run_id long, axis string, x1 int, y1 int, x2 int, y2 int")
    got = {r.pid_idx: r.run_id for r in association.direct(labels, runs, 34.0, 5.0, 50.0).collect()}
    assert got == {1: 11, 2: 12}


def test_thin_and_merge_tokens(spark):
    from isoline.operators import breaks

    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5), (1, 2, 5.0, 5.0, 0.9), (1, 3, 40.0, 0.0, 0.5)], "sheet_id int, point_id int, x double, y double, conf double")
    assert {r.point_id for r in breaks.thin(points, 30.0).collect()} == {2, 3}
    tokens = spark.createDataFrame([(1, 1, "CDA", 0, 0, 10, 10), (1, 2, "CDA", 4, 0, 14, 10), (1, 3, "CDA", 90, 0, 99, 10), (1, 4, "CCC", 0, 0, 10, 10)], "sheet_id int, token_id int, text string, x1 int, y1 int, x2 int, y2 int")
    got = sorted((r.text, r.x1, r.n) for r in breaks.merge_tokens(tokens).collect())
    assert got == [("CCC", 0.0, 1), ("CDA", 2.0, 2), ("CDA", 90.0, 1)]


def test_elbows_and_headers(spark):
    from isoline.operators import tracing

    cols = "sheet_id int, run_id long, axis string, x1 int, y1 int, x2 int, y2 int"
    rows = [(1, 1, "H", 0, 0, 50, 0), (1, 2, "V", 51, 1, 51, 40), (1, 3, "H", 51, 40, 90, 40), (1, 4, "V", 90, 40, 90, 80), (1, 5, "H", 91, 40, 130, 40), (1, 6, "H", 300, 0, 340, 0)]
    got = {r.run_id: (r.n_runs, len(r.points)) for r in tracing.merge_elbows(spark.createDataFrame(rows, cols), 2.0).collect()}
    assert got == {1: (3, 4), 4: (1, 2), 5: (1, 2), 6: (1, 2)}
    ring = [(1, 1, "H", 0, 0, 10, 0), (1, 2, "V", 10, 0, 10, 10), (1, 3, "H", 10, 10, 0, 10), (1, 4, "V", 0, 10, 0, 0)]
    got = tracing.merge_elbows(spark.createDataFrame(ring, cols), 1.0).collect()
    assert [(r.run_id, r.n_runs) for r in got] == [(1, 4)]
    line = [(1, 1, "H", 0, 0, 50, 0), (1, 2, "H", 80, 1, 120, 1), (1, 3, "H", 200, 0, 210, 0), (1, 4, "V", 0, 0, 0, 9)]
    stop = spark.createDataFrame([(1, 60, -5, 70, 5)], "sheet_id int, x1 int, y1 int, x2 int, y2 int")
    assert tracing.bridge_headers(spark.createDataFrame(line, cols), 45, 4, stop).count() == 4
    got = sorted((r.axis, r.lo, r.hi, r.n_runs) for r in tracing.bridge_headers(spark.createDataFrame(line, cols), 45, 4).collect())
    assert got == [("H", 0, 120, 2), ("H", 200, 210, 1), ("V", 0, 9, 1)]


def test_junctions_and_edits(spark):
    from isoline.operators import tracing

    arms = {1: [(1, 0)], 2: [(1, 0), (-1, 0)], 3: [(1, 0), (0, 1)], 4: [(1, 0), (-1, 0), (0, 1)], 5: [(1, 0), (-1, 0), (0, 1), (0, -1)], 6: [(1, 0)] * 5}
    df = spark.createDataFrame([(1, n, k, float(x), float(y)) for n, v in arms.items() for k, (x, y) in enumerate(v)], "sheet_id int, node_id int, arm int, dx double, dy double")
    got = {r.node_id: r.kind for r in tracing.junctions(df).collect()}
    assert got == {1: "endpoint", 2: "straight", 3: "corner", 4: "tee", 5: "crossover", 6: "complex"}
    runs = spark.createDataFrame([(1, 5, "red", "a"), (1, 7, "blue", None), (1, 9, "red", "c")], "sheet_id int, run_id int, color string, label string")
    changes = spark.createDataFrame([(1, 5, None, "green", None), (1, 9, True, None, None)], "sheet_id int, run_id int, deleted boolean, color string, label string")
    got = [(r.run_idx, r.run_id, r.color, r.label) for r in tracing.renumber(tracing.edit(runs, changes, ["color", "label"])).orderBy("run_id").collect()]
    assert got == [(0, 5, "green", "a"), (1, 7, "blue", None)]


def test_shapes(spark):
    from isoline.operators import shapes

    row = spark.range(1).select(
        shapes.straight_pieces(F.expr("array(array(0, 0), array(10, 0), array(20, 0), array(20, 10))")).alias("two"),
        shapes.straight_pieces(F.expr("array(array(0, 0), array(10, 0))")).alias("one"),
        shapes.is_gradual(F.expr("array(array(0, 0), array(10, 1), array(20, 4), array(29, 9))")).alias("yes"),
        shapes.is_gradual(F.expr("array(array(0, 0), array(10, 0), array(10, 10), array(0, 10))")).alias("no"),
    ).first()
    assert (len(row.two), len(row.one), row.yes, row.no) == (2, 1, True, False)


def _bridged(runs, reach, allowed):
    """Rounds of joins in plain Python: runs is {id: points}, allowed judges two ends as (id, which, place, way out)."""
    cur = {k: (p, False, 1) for k, p in runs.items()}
    while True:
        ends = [(k, w, p[i], (p[i][0] - p[j][0], p[i][1] - p[j][1]), grew, sum(math.dist(a, b) for a, b in zip(p, p[1:]))) for k, (p, grew, _) in cur.items() for w, i, j in ((1, 0, 1), (2, -1, -2))]
        ranks = []
        for a, b in itertools.permutations(ends, 2):
            gap = math.dist(a[2], b[2])
            if a[0] < b[0] and gap <= reach and allowed(a, b, gap):
                ranks.append((gap, a[0], b[0], a[1], b[1]))
        if not ranks:
            return {k: (p, n) for k, (p, _, n) in cur.items()}
        first = {}
        for r in ranks:
            for k in r[1:3]:
                first[k] = min(r, first.get(k, r))
        for r in sorted(set(first.values())):
            if first[r[1]] == r == first[r[2]]:
                (p, _, n), (q, _, m) = cur[r[1]], cur.pop(r[2])
                way = (p if r[3] == 2 else p[::-1]) + (q if r[4] == 1 else q[::-1])
                cur[r[1]] = ([x for i, x in enumerate(way) if i == 0 or x != way[i - 1]], True, n + m)


@pytest.mark.parametrize("seed", [1, 2])
def test_bridges_against_rounds(spark, seed):
    from isoline.operators import bridging

    r = random.Random(seed)
    runs = {}
    for k in range(40):
        x, y, n = float(r.randrange(0, 400, 10)), float(r.randrange(0, 300, 10)), r.choice([20, 40, 90, 160])
        runs[k] = [(x, y), r.choice([(x + n, y), (x, y + n), (x + n / 2, y + n / 2), (x + n, y + 4)])]
    valves = [(x, y, x + 20, y + 20) for x, y in ((float(r.randrange(400)), float(r.randrange(300))) for _ in range(9))]
    blocks = [(100.0, 100.0, 140.0, 130.0)]
    df = spark.createDataFrame([(1, k, [list(q) for q in p]) for k, p in runs.items()], "sheet_id int, run_id int, points array<array<double>>")
    box = lambda rows: spark.createDataFrame([(1, *b) for b in rows], "sheet_id int, x1 double, y1 double, x2 double, y2 double")

    def open_(a, b):
        return not any(min(a[2][0], b[2][0]) <= x2 and max(a[2][0], b[2][0]) >= x1 and min(a[2][1], b[2][1]) <= y2 and max(a[2][1], b[2][1]) >= y1 for x1, y1, x2, y2 in blocks)

    def bend(a, b, gap):
        cosine = -(a[3][0] * b[3][0] + a[3][1] * b[3][1]) / (math.hypot(*a[3]) * math.hypot(*b[3]))
        return (a[4] or b[4] or min(a[5], b[5]) <= 60) and math.degrees(math.acos(max(-1, min(1, cosine)))) <= 75 and open_(a, b)

    def valve(a, b, gap):
        flat, tall = ([abs(e[3][i]) >= 1.5 * abs(e[3][1 - i]) for e in (a, b)] for i in (0, 1))
        dx, dy = abs(a[2][0] - b[2][0]), abs(a[2][1] - b[2][1])
        line = (all(flat) and dy <= 6 and dx > 0) or (all(tall) and dx <= 6 and dy > 0)
        mx, my = (a[2][0] + b[2][0]) / 2, (a[2][1] + b[2][1]) / 2
        held = flat[0] == flat[1] and tall[0] == tall[1] and any(x1 - 15 <= mx <= x2 + 15 and y1 - 15 <= my <= y2 + 15 for x1, y1, x2, y2 in valves)
        near = any(x1 - 40 <= e[2][0] <= x2 + 40 and y1 - 40 <= e[2][1] <= y2 + 40 for e in (a, b) for x1, y1, x2, y2 in valves)
        return gap > 0 and near and (line or held) and open_(a, b)

    got = {x.run_id: ([tuple(q) for q in x.points], x.n_runs) for x in bridging.bridge_bends(df, 30.0, 60.0, 75.0, box(blocks)).collect()}
    assert got == _bridged(runs, 30, bend) and max(n for _, n in got.values()) > 1
    got = {x.run_id: ([tuple(q) for q in x.points], x.n_runs) for x in bridging.bridge_valves(df, box(valves), 40.0, 6.0, box(blocks)).collect()}
    assert got == _bridged(runs, 40, valve) and max(n for _, n in got.values()) > 1
    assert bridging.bridge_valves(df, box(valves).where("false"), 40.0).count() == len(runs)
