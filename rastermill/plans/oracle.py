"""The queries' SQL for DuckDB over views of the given tables, written apart from the operators."""

from __future__ import annotations

from . import fixtures as fx

ONE = 65536

_duck = lambda sql: fx.render(sql, "duck")
H, W = fx.H, fx.W
KCELL = "image_id, channel, row, col"

_CTE = {
    "px": _duck(fx.PX_LI),
    "emb": fx.PX_EMB["duck"].replace("{t:embeddings}", "embeddings"),
    "sparse": _duck(fx.SPARSE),
    "strokes": _duck(fx.STROKES),
    "log": _duck(fx.STROKE_LOG),
    "images": _duck(fx.IMAGES),
    "curves": _duck(fx.CURVES),
    "colours": "SELECT image_id, channel, CAST(FLOOR(AVG(value)) AS INT) AS colour FROM px GROUP BY 1,2",
    "canvas": f"SELECT p.image_id, p.channel, p.row, p.col, c.colour AS value FROM px p JOIN colours c ON p.image_id=c.image_id AND p.channel=c.channel",
    "res": "SELECT p.image_id, p.channel, p.row, p.col, p.value AS target, c.colour AS canvas, p.value-c.colour AS diff, ABS(p.value-c.colour) AS err FROM px p JOIN colours c ON p.image_id=c.image_id AND p.channel=c.channel",
    "errors": "SELECT image_id, channel, SUM(err) AS sum_err, MAX(err) AS max_err, MIN(err) AS min_err, MEDIAN(err) AS median_err FROM res GROUP BY 1,2",
    "quad4": f"SELECT *, CAST(CASE WHEN row>={H // 2} THEN 8 ELSE 0 END + CASE WHEN col>={W // 2} THEN 4 ELSE 0 END + CASE WHEN row%{H // 2}>={H // 4} THEN 2 ELSE 0 END + CASE WHEN col%{W // 2}>={W // 4} THEN 1 ELSE 0 END AS INT) AS code FROM res",
    "qerr": "SELECT image_id, channel, code, SUM(err) AS err FROM quad4 GROUP BY 1,2,3",
    "fp": "SELECT s.image_id, s.stroke_id, s.channel, p.row, p.col, CAST(CASE WHEN p.row>=s.row+s.size//2 THEN 2 ELSE 0 END + CASE WHEN p.col>=s.col+s.size//2 THEN 1 ELSE 0 END AS INT) AS quarter, [s.i0,s.i1,s.i2,s.i3] AS idx FROM strokes s JOIN px p ON p.image_id=s.image_id AND p.channel=s.channel AND p.row>=s.row AND p.row<s.row+s.size AND p.col>=s.col AND p.col<s.col+s.size",
    "sched0": "SELECT image_id, stroke_id, channel, ROW_NUMBER() OVER (PARTITION BY image_id, channel ORDER BY stroke_id)-1 AS k, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY stroke_id)-1 AS i FROM strokes",
    "sched": "SELECT image_id, stroke_id, channel, k, k>=4 AND (k-4)%4=0 AS quad_switch, CASE WHEN k>=4 THEN (k-4)//4 END AS segment, i>=20 AND (i-20)%8=0 AS cycle_switch, i%3 AS slot FROM sched0",
    "parts": "SELECT image_id, stroke_id, 0 AS part, i0 AS code FROM strokes UNION ALL SELECT image_id, stroke_id, 1, i1 FROM strokes UNION ALL SELECT image_id, stroke_id, 2, i2 FROM strokes UNION ALL SELECT image_id, stroke_id, 3, i3 FROM strokes",
    "sat": "SELECT a.image_id, a.channel, a.row, a.col, SUM(a.part) OVER (PARTITION BY a.image_id, a.channel, a.col ORDER BY a.row) AS total FROM (SELECT image_id, channel, row, col, SUM(value) OVER (PARTITION BY image_id, channel, row ORDER BY col) AS part FROM px) a",
    "fitstats": "SELECT f.image_id, f.stroke_id, f.channel, f.quarter, COUNT(*) AS n, SUM(r.diff) AS total FROM fp f JOIN res r ON f.image_id=r.image_id AND f.channel=r.channel AND f.row=r.row AND f.col=r.col GROUP BY 1,2,3,4",
    "runs0": _duck(fx.RUNS),
    "runs": f"SELECT *, {H * W * 24}/bits AS rate, CASE WHEN mse=0 THEN CAST('inf' AS DOUBLE) ELSE {H * W * 24}/bits/mse END AS efficiency FROM runs0",
    "sweep": "SELECT *, CASE WHEN mse=0 THEN MAX(CASE WHEN mse>0 THEN efficiency END) OVER (PARTITION BY image_id, codec ORDER BY quality ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE efficiency END AS shown FROM runs",
    "pairs": "SELECT a.image_id, a.bits AS a_bits, a.mse AS a_mse, b.quality AS b_quality, b.bits AS b_bits, b.mse AS b_mse, CASE WHEN a.efficiency>b.efficiency THEN 'a' ELSE 'b' END AS winner FROM runs a JOIN runs b ON a.image_id=b.image_id WHERE a.codec='tile' AND a.quality=4 AND b.codec='uniform'",
}


def _book(book: list[int], total: str, n: str, what: str = "idx") -> str:
    """The place (or the entry) of the book that is nearest to total / n, lowest place first."""
    away = ", ".join(f"ABS({m}*({n})-({total}))" for m in book)
    idx = f"(list_position([{away}], list_min([{away}]))-1)"
    return idx if what == "idx" else f"([{', '.join(map(str, book))}])[{idx}+1]"


def _layer(k: int, source: str, half: int, book: list[int]) -> dict[str, str]:
    """CTEs of layer k over source (cell, target, canvas): its codes by quarter, then the cells after it."""
    return {
        f"q{k}": f"SELECT image_id, channel, row//{half} AS qr, col//{half} AS qc, {_book(book, 'SUM(target-canvas)', 'COUNT(*)')} AS idx FROM {source} GROUP BY 1,2,3,4",
        f"l{k}": f"SELECT s.image_id, s.channel, s.row, s.col, s.target, LEAST(255, GREATEST(0, s.canvas + ([{', '.join(map(str, book))}])[q.idx+1])) AS canvas FROM {source} s JOIN q{k} q ON s.image_id=q.image_id AND s.channel=q.channel AND s.row//{half}=q.qr AND s.col//{half}=q.qc",
    }


_B1 = fx.BOOKS[1]
_CTE |= _layer(0, "res", 4, _B1) | _layer(1, "l0", 2, _B1) | _layer(2, "l1", 1, _B1)
for _b, _entries in fx.BOOKS.items():
    _CTE |= {x.replace("q0", f"bq{_b}").replace("l0", f"bl{_b}"): y.replace("q0", f"bq{_b}").replace("l0", f"bl{_b}") for x, y in _layer(0, "res", 2, _entries).items()}

_CTE["thumb"] = f"SELECT image_id, channel, CAST(row*6//{H} AS INT) AS row, CAST(col*8//{W} AS INT) AS col, CAST(SUM(value)//COUNT(*) AS INT) AS value FROM px GROUP BY image_id, channel, row*6//{H}, col*8//{W}"
_CTE["tres"] = f"SELECT p.image_id, p.channel, p.row, p.col, p.value AS target, t.value AS canvas FROM px p JOIN thumb t ON p.image_id=t.image_id AND p.channel=t.channel AND p.row*6//{H}=t.row AND p.col*8//{W}=t.col"
_TREE = {}
for _k, _half in enumerate((4, 2, 1)):
    _TREE |= {x.replace("q", "tq").replace("l", "tl"): y.replace(f"JOIN q{_k} ", f"JOIN tq{_k} ") for x, y in _layer(_k, "tres" if not _k else f"tl{_k - 1}", _half, _B1).items()}
_CTE |= _TREE
for _c, _size, _entries in fx.CONFIGS:
    _CTE |= {x.replace("q0", f"cq{_c}").replace("l0", f"cl{_c}"): y.replace("q0", f"cq{_c}").replace("l0", f"cl{_c}") for x, y in _layer(0, "res", _size // 2, _entries).items()}
#: The worst of four regions of the worst channel of each image, and the layer of squares of 4 in it.
_CTE["worst1"] = "SELECT image_id, channel FROM errors QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY sum_err DESC, channel)=1"
_CTE["quad2"] = f"SELECT *, CASE WHEN row>={H // 2} THEN 2 ELSE 0 END + CASE WHEN col>={W // 2} THEN 1 ELSE 0 END AS code FROM res"
_CTE["worst2"] = "SELECT q.image_id, q.channel, q.code FROM (SELECT image_id, channel, code, SUM(err) AS err FROM quad2 GROUP BY 1,2,3) q JOIN worst1 w ON q.image_id=w.image_id AND q.channel=w.channel QUALIFY ROW_NUMBER() OVER (PARTITION BY q.image_id ORDER BY q.err DESC, q.code)=1"
_CTE["sel"] = "SELECT q.* FROM quad2 q JOIN worst2 w ON q.image_id=w.image_id AND q.channel=w.channel AND q.code=w.code"
_CTE |= {x.replace("q0", "sq").replace("l0", "sl"): y.replace("q0", "sq").replace("l0", "sl") for x, y in _layer(0, "sel", 2, _B1).items()}

#: Three layers in the two worst of eight regions of the selected channels: rg<k> cells before layer k, rs<k> its regions, rq<k> its codes.
_CTE["rg0"] = f"SELECT image_id, channel, row, col, target, canvas, CAST(CASE WHEN row>={H // 2} THEN 4 ELSE 0 END + CASE WHEN col>={W // 2} THEN 2 ELSE 0 END + CASE WHEN row%{H // 2}>={H // 4} THEN 1 ELSE 0 END AS INT) AS code FROM res"
for _k, _half in enumerate((4, 2, 1)):
    _CTE[f"re{_k}"] = f"SELECT image_id, channel, code, SUM(ABS(target-canvas)) AS err FROM rg{_k} GROUP BY 1,2,3"
    _CTE[f"rc{_k}"] = f"SELECT *, FIRST_VALUE(err) OVER w AS e1, NTH_VALUE(err, 2) OVER (PARTITION BY image_id ORDER BY err DESC, channel ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e2, NTH_VALUE(err, 3) OVER (PARTITION BY image_id ORDER BY err DESC, channel ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e3, ROW_NUMBER() OVER w AS place FROM (SELECT image_id, channel, SUM(err) AS err FROM re{_k} GROUP BY 1,2) WINDOW w AS (PARTITION BY image_id ORDER BY err DESC, channel)"
    _CTE[f"rs{_k}"] = f"SELECT e.image_id, e.channel, e.code FROM re{_k} e JOIN rc{_k} c ON e.image_id=c.image_id AND e.channel=c.channel WHERE c.place<=CASE WHEN c.e1>2*c.e2 THEN 1 WHEN c.e2>2*c.e3 THEN 2 ELSE 3 END QUALIFY ROW_NUMBER() OVER (PARTITION BY e.image_id, e.channel ORDER BY e.err DESC, e.code)<=2"
    _CTE[f"rq{_k}"] = f"SELECT g.image_id, g.channel, g.code, CAST(row//{_half} AS INT) AS qr, CAST(col//{_half} AS INT) AS qc, CAST({_book(_B1, 'SUM(target-canvas)', 'COUNT(*)')} AS INT) AS idx FROM rg{_k} g JOIN rs{_k} s ON g.image_id=s.image_id AND g.channel=s.channel AND g.code=s.code GROUP BY g.image_id, g.channel, g.code, row//{_half}, col//{_half}"
    _CTE[f"rg{_k + 1}"] = f"SELECT g.image_id, g.channel, g.row, g.col, g.target, CASE WHEN q.idx IS NULL THEN g.canvas ELSE LEAST(255, GREATEST(0, g.canvas+([{', '.join(map(str, _B1))}])[q.idx+1])) END AS canvas, g.code FROM rg{_k} g LEFT JOIN rq{_k} q ON g.image_id=q.image_id AND g.channel=q.channel AND g.code=q.code AND g.row//{_half}=q.qr AND g.col//{_half}=q.qc"

_NEEDS = {
    "rg0": ["res"], **{f"re{k}": [f"rg{k}"] for k in range(3)}, **{f"rc{k}": [f"re{k}"] for k in range(3)}, **{f"rs{k}": [f"rc{k}"] for k in range(3)}, **{f"rq{k}": [f"rs{k}"] for k in range(3)}, **{f"rg{k + 1}": [f"rq{k}"] for k in range(3)},
    "thumb": ["px"], "tres": ["px", "thumb"], "tq0": ["tres"], "tl0": ["tq0"], "tq1": ["tl0"], "tl1": ["tq1"], "tq2": ["tl1"], "tl2": ["tq2"], "worst1": ["errors"], "quad2": ["res"], "worst2": ["worst1", "quad2"], "sel": ["worst2", "quad2"], "sq": ["sel"], "sl": ["sq"],
    **{f"cq{c}": ["res"] for c, _, _ in fx.CONFIGS}, **{f"cl{c}": [f"cq{c}"] for c, _, _ in fx.CONFIGS},
    "colours": ["px"], "canvas": ["colours"], "res": ["colours"], "errors": ["res"], "quad4": ["res"], "qerr": ["quad4"], "fp": ["strokes", "px"], "sched0": ["strokes"], "sched": ["sched0"], "parts": ["strokes"], "sat": ["px"],
    "fitstats": ["fp", "res"], "runs": ["runs0"], "sweep": ["runs"], "pairs": ["runs"], "q0": ["res"], "l0": ["q0"], "q1": ["l0"], "l1": ["q1"], "q2": ["l1"], "l2": ["q2"], **{f"bq{b}": ["res"] for b in fx.BOOKS}, **{f"bl{b}": [f"bq{b}"] for b in fx.BOOKS},
}


def _with(names: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({_CTE[n]})" for n in order) + " " + body


def _recursive(names: str, ctes: str, body: str) -> str:
    return _with(names, "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f", {ctes} {body}"


_CTE["met"] = "SELECT a.image_id, a.channel, a.stroke_id AS first, b.stroke_id AS second FROM strokes a JOIN strokes b ON a.image_id=b.image_id AND a.channel=b.channel AND a.stroke_id<b.stroke_id AND a.row<b.row+b.size AND b.row<a.row+a.size AND a.col<b.col+b.size AND b.col<a.col+a.size"
_NEEDS["met"] = ["strokes"]
_LEVELS = "lv AS (SELECT image_id, channel, stroke_id, 0 AS level FROM strokes UNION SELECT o.image_id, o.channel, o.second, l.level+1 FROM lv l JOIN met o ON o.image_id=l.image_id AND o.channel=l.channel AND o.first=l.stroke_id)"
#: One square after the other: step is the square that has just been fitted, quarter and idx what it was to each cell.
_SEQUENCE = f"""seq AS (SELECT {KCELL}, target, canvas, -1 AS step, CAST(NULL AS INT) AS quarter, CAST(NULL AS BIGINT) AS idx FROM res
 UNION ALL SELECT {KCELL}, target, CASE WHEN quarter IS NULL THEN canvas ELSE LEAST(255, GREATEST(0, canvas+([{', '.join(map(str, fx.BOOK))}])[idx+1])) END, step, quarter, CASE WHEN quarter IS NOT NULL THEN idx END
 FROM (SELECT *, {_book(fx.BOOK, 'total', 'n')} AS idx FROM (SELECT *, SUM(target-canvas) OVER w AS total, COUNT(*) OVER w AS n
  FROM (SELECT r.image_id, r.channel, r.row, r.col, r.target, r.canvas, r.step+1 AS step, CASE WHEN s.stroke_id IS NOT NULL THEN CAST(CASE WHEN r.row>=s.row+s.size//2 THEN 2 ELSE 0 END + CASE WHEN r.col>=s.col+s.size//2 THEN 1 ELSE 0 END AS INT) END AS quarter
   FROM seq r LEFT JOIN strokes s ON s.image_id=r.image_id AND s.channel=r.channel AND s.stroke_id=r.step+1 AND r.row>=s.row AND r.row<s.row+s.size AND r.col>=s.col AND r.col<s.col+s.size WHERE r.step<61)
  WINDOW w AS (PARTITION BY image_id, channel, quarter))))"""


#: Every square of 4 and 8: sums over the cells of each of its quarters.
_CTE["gains"] = " UNION ALL ".join(
    f"SELECT image_id, channel, CAST(r AS INT) AS row, CAST(c AS INT) AS col, {size} AS size, CAST(SUM(g) AS BIGINT) AS gain FROM (SELECT image_id, channel, r, c, q, list_max([{', '.join(f'2*{m}*SUM(diff)-COUNT(*)*{m * m}' for m in fx.BOOK)}]) AS g FROM (SELECT image_id, channel, diff, row-i AS r, col-j AS c, i//{size // 2}*2+j//{size // 2} AS q FROM res CROSS JOIN (SELECT range AS i FROM range({size})) CROSS JOIN (SELECT range AS j FROM range({size}))) WHERE r BETWEEN 0 AND {H - size} AND c BETWEEN 0 AND {W - size} GROUP BY 1,2,3,4,5) GROUP BY 1,2,3,4"
    for size in (4, 8)
)
_NEEDS["gains"] = ["res"]
#: The best square of what is left, one at a time in each channel.
_BEST = "FIRST_VALUE({'row': row, 'col': col, 'size': size, 'gain': gain}) OVER (PARTITION BY image_id, channel ORDER BY gain DESC, row, col, size)"
_PICKS = f"picks AS (SELECT image_id, channel, row, col, size, gain, {_BEST} AS b FROM gains WHERE gain>0 UNION ALL SELECT image_id, channel, row, col, size, gain, {_BEST} AS b FROM picks WHERE NOT (row<b.row+b.size AND b.row<row+size AND col<b.col+b.size AND b.col<col+size))"
#: The weights of a layer's codes, the two lightest becoming one in each step; what the steps weigh is what the code costs.
_HUFFMAN = f"hist AS (SELECT image_id, idx, COUNT(*) AS n FROM (SELECT image_id, channel, row//2 AS qr, col//2 AS qc, {_book(fx.BOOKS[1], 'SUM(diff)', 'COUNT(*)')} AS idx FROM res GROUP BY 1,2,3,4) GROUP BY 1,2), huff AS (SELECT image_id, list_sort(list(CAST(n AS BIGINT))) AS w, CASE WHEN COUNT(*)=1 THEN CAST(SUM(n) AS BIGINT) ELSE 0 END AS cost FROM hist GROUP BY 1 UNION ALL SELECT image_id, list_sort(list_append(w[3:], w[1]+w[2])), cost+w[1]+w[2] FROM huff WHERE len(w)>1)"


def _planes(*planes: str) -> str:
    wide = "SELECT image_id, row, col, CAST(MAX(CASE WHEN channel=0 THEN value END) AS BIGINT) AS r, CAST(MAX(CASE WHEN channel=1 THEN value END) AS BIGINT) AS g, CAST(MAX(CASE WHEN channel=2 THEN value END) AS BIGINT) AS b FROM px GROUP BY 1,2,3"
    each = " UNION ALL ".join(f"SELECT image_id, {c} AS channel, row, col, CAST(LEAST(255000000, GREATEST(0, {p}))//1000000 AS INT) AS value FROM w" for c, p in enumerate(planes))
    return _with("px", "").rstrip() + f", w AS ({wide}) {each}"


_PI = "PI()"
_KERNELS = {  # of x, with how far they reach
    "bilinear": ("GREATEST(0.0::DOUBLE, 1-ABS(x))", 1),
    "bicubic": ("CASE WHEN ABS(x)<1 THEN (1.5::DOUBLE*ABS(x)-2.5::DOUBLE)*x*x+1 WHEN ABS(x)<2 THEN ((-0.5::DOUBLE*ABS(x)+2.5::DOUBLE)*ABS(x)-4)*ABS(x)+2 ELSE 0 END", 2),
    "lanczos": (f"CASE WHEN x=0 THEN 1 WHEN ABS(x)<3 THEN SIN({_PI}*x)/({_PI}*x)*SIN({_PI}*x/3)/({_PI}*x/3) ELSE 0 END", 3),
}


def _weights(size: int, new: int, kernel: str) -> str:
    """A table (i, o, weight): taps of each output, edges held, normed to ONE, what rounding leaves on the largest tap."""
    f, reach = _KERNELS[kernel]
    scale = f"GREATEST(1.0::DOUBLE, {size}::DOUBLE/{new})"
    outs = f"SELECT CAST(range AS INT) AS o, (range+0.5::DOUBLE)*{size}/{new}-0.5::DOUBLE AS centre FROM range({new})"
    taps = f"SELECT o, GREATEST(0, LEAST({size - 1}, j)) AS i, (j-centre)/{scale} AS x FROM (SELECT o, centre, unnest(range(CAST(FLOOR(centre-{reach}*{scale}) AS INT), CAST(CEIL(centre+{reach}*{scale}) AS INT)+1)) AS j FROM ({outs}))"
    normed = f"SELECT o, i, CAST(FLOOR(v/SUM(v) OVER (PARTITION BY o)*{ONE}+0.5::DOUBLE) AS BIGINT) AS u FROM (SELECT o, i, SUM({f}) AS v FROM ({taps}) GROUP BY 1,2)"
    return f"(SELECT CAST(i AS INT) AS i, o, u+CASE WHEN ROW_NUMBER() OVER (PARTITION BY o ORDER BY u DESC, i)=1 THEN {ONE}-SUM(u) OVER (PARTITION BY o) ELSE 0 END AS weight FROM ({normed}) WHERE u<>0) AS t"


def _resampled(source: str, h: int, w: int, n_h: int, n_w: int, kernel: str) -> str:
    across = f"SELECT image_id, channel, row, o AS c, SUM(value*weight) AS s FROM {source} JOIN {_weights(w, n_w, kernel)} ON col=i GROUP BY 1,2,3,4"
    down = f"SELECT image_id, channel, o AS r, c, SUM(s*weight) AS s FROM ({across}) JOIN {_weights(h, n_h, kernel)} ON row=i GROUP BY 1,2,3,4"
    return f"SELECT image_id, channel, r AS row, c AS col, CAST(GREATEST(0, LEAST(255, (GREATEST(0, s+{ONE * ONE // 2}))//{ONE * ONE})) AS INT) AS value FROM ({down})"


def _spread(n: int) -> str:
    return f"list_transform(range({n}), lambda i: CAST(FLOOR((lo*{n - 1}+i*(hi-lo))/{n - 1}) AS INT))"


def _codebook(bits: int, stable: bool) -> str:
    n = 1 << bits
    full = "s"
    if stable:
        far = "list_min(list_filter(s, lambda v: ABS(v)=list_max(list_transform(s, lambda u: ABS(u)))))"
        full = f"CASE WHEN list_min(list_transform(s, lambda v: ABS(v)))>1 THEN list_sort(list_concat(list_filter(s, lambda v: v<>{far}), [0])) ELSE s END"
    return _with("res", f"SELECT image_id, channel, array_to_string(CASE WHEN lo+1>=hi THEN [lo] WHEN hi-lo<{n} THEN CAST(range(lo, hi) AS INT[]) ELSE {full} END, ',') AS book FROM (SELECT *, {_spread(n)} AS s FROM (SELECT image_id, channel, MIN(diff) AS lo, MAX(diff) AS hi FROM res GROUP BY 1,2))")


_X = "(CASE WHEN n>1 THEN i*n/(n-1) ELSE 0 END)"
_SIZES = f"""SELECT image_id, CAST(i AS INT) AS stroke_id, CAST(CASE WHEN cutoff<=0 THEN e WHEN cutoff>=3 THEN s ELSE FLOOR(ROUND(
 CASE WHEN {_X}>=n*cutoff THEN e ELSE progress*(CASE WHEN softness<=0 THEN (CASE WHEN {_X}>=n*cutoff/2 THEN e ELSE s END) ELSE s+(e-s)/(1+EXP(-(1/softness*(SQRT(ABS(e-s))/n))*({_X}-n*cutoff/2))) END)
 + (1-progress)*(s+{_X}/(n*cutoff)*(e-s)) END, 6)/2)*2 END AS INT) AS size
FROM (SELECT image_id, ROUND(cutoff, 4) AS cutoff, ROUND(softness, 4) AS softness, ROUND(progress, 4) AS progress, CAST(stroke_count AS DOUBLE) AS n, CAST(start AS DOUBLE) AS s, CAST(end_ AS DOUBLE) AS e, CAST(unnest(range(stroke_count)) AS DOUBLE) AS i FROM curves)"""
_CTE["sizes"] = _SIZES
_NEEDS["sizes"] = ["curves"]

_AUTO = """SELECT image_id, downsample_rate, stroke_count, cutoff, softness, progress, CAST(FLOOR(ROUND(size_start*(low-2),6))+2 AS INT) AS size_start_px, CAST(FLOOR(ROUND(size_end*(low-2),6))+2 AS INT) AS size_end_px,
 CAST(FLOOR(ROUND(warmup*stroke_count,6)) AS BIGINT) AS warmup_strokes, CAST(FLOOR(ROUND(stroke_count*0.9::DOUBLE,6)) AS BIGINT) AS cycle_start
FROM (SELECT image_id, low, downsample_rate, n AS stroke_count, COALESCE(softness,0.5) AS softness, COALESCE(progress,0.5) AS progress,
 COALESCE(cutoff, CASE WHEN coarse THEN CASE WHEN n>20000 THEN 0.3 ELSE 0.7 END END, ROUND(0.01::DOUBLE+POW(1/1.0000115::DOUBLE, n+15000),4)) AS cutoff,
 COALESCE(warmup, CASE WHEN coarse THEN CASE WHEN n>20000 THEN 0.1 ELSE 0.7 END END, ROUND(GREATEST(0, LEAST(1, 0.75::DOUBLE-1.4e-5::DOUBLE*(n-1000)*(n-1000)/550000)),6)) AS warmup,
 COALESCE(size_start, CASE WHEN coarse AND size_end IS NULL THEN CASE WHEN n>20000 THEN 0.05 ELSE 0.1 END END, ROUND(0.3::DOUBLE+POW(1/1.00095::DOUBLE, n+7000),6)) AS size_start,
 COALESCE(size_end, CASE WHEN coarse AND size_start IS NULL THEN CASE WHEN n>20000 THEN 0.01 ELSE 0.03 END END, ROUND(0.01::DOUBLE+POW(1/1.00015::DOUBLE, n+10200),6)) AS size_end
FROM (SELECT *, LEAST(width,height) AS low, CASE WHEN LEAST(width,height)<600 THEN 1.0::DOUBLE ELSE ROUND(LEAST(width,height)/500,6) END AS downsample_rate, thumbnail AND rate_init<32 AS coarse,
 COALESCE(stroke_count, CAST(FLOOR(20000+0.0015::DOUBLE*(GREATEST(width,height)+3200)*(GREATEST(width,height)+3200)) AS BIGINT)) AS n FROM images))"""


def _halves(depth: int, most: int) -> str:
    """Halving unrolled: CTEs of (h, w, n, going)."""
    out = ["d0 AS (SELECT image_id, height, width, size, height AS h, width AS w, 0 AS n, TRUE AS going FROM curves)"]
    for k in range(most):
        side, other = ("h", "w") if k % 2 == 0 else ("w", "h")
        ok = f"going AND {side}//2>=size"
        out.append(f"d{k + 1} AS (SELECT image_id, height, width, size, CASE WHEN {ok} THEN {side}//2 ELSE {side} END AS {side}, {other}, n + CASE WHEN {ok} THEN 1 ELSE 0 END AS n, {ok} AS going FROM d{k})")
    return ", ".join(out)


def _bounds(depth: int, padding: int) -> str:
    out = [f"b0 AS (SELECT image_id, height, width, size, code, 0 AS r0, height AS r1, 0 AS c0, width AS c1 FROM curves CROSS JOIN (SELECT CAST(range AS INT) AS code FROM range({1 << depth})))"]
    for k in range(depth):
        x, y = ("r", "c") if k % 2 == 0 else ("c", "r")
        bit = f"(code//{1 << (depth - 1 - k)})%2=1"
        out.append(f"b{k + 1} AS (SELECT image_id, height, width, size, code, CASE WHEN {bit} THEN ({x}0+{x}1)//2 ELSE {x}0 END AS {x}0, CASE WHEN {bit} THEN {x}1 ELSE ({x}0+{x}1)//2 END AS {x}1, {y}0, {y}1 FROM b{k})")
    held = lambda v, side: f"GREATEST(0, LEAST(GREATEST(0,{side}-size), {v}))"
    cols = ", ".join(f"{held(f'{x}0-{padding}', s)} AS {x}0, {held(f'{x}1-size+{padding}', s)} AS {x}1" for x, s in (("r", "height"), ("c", "width")))
    return ", ".join(out) + f" SELECT image_id, code, r0, c0, CASE WHEN r1<=r0 THEN r0+1 ELSE r1 END AS r1, CASE WHEN c1<=c0 THEN c0+1 ELSE c1 END AS c1 FROM (SELECT image_id, code, {cols} FROM b{depth})"


_M = fx.BOOK
_LOSS = "MAX(CASE WHEN channel={c} THEN mse END) AS mse{c}"


#: Types of columns that DuckDB would otherwise make wider or narrower than Spark does.
_KINDS = {
    "BIGINT": {"channel_error": "sum_err", "quadrant_error": "err", "quadrant_pyramid": "err", "worst_quadrant": "err", "top_k_quadrants": "err", "rank_channels": "sum_err", "summed_area": "total", "rect_stats": "total", "stroke_fit": "total", "score_candidates": "gain", "progress_curve": "bits", "encode_layers": "sse", "replay_equals_fit": "off", "param_sweep": "sse", "efficiency": "bits", "codec_compare": "a_bits b_bits", "quality_sweep": "bits", "win_rate": "wins", "stream_progress": "bits", "stream_rate": "bits"},
    "INTEGER": {"assemble_cells": "n", "top_k_quadrants": "place", "rank_channels": "place", "pack_codes": "pad", "unpack_codes": "pos", "rect_stats": "n", "stroke_fit": "n", "stroke_schedule": "k slot", "progress_curve": "i strokes"},
}


def sql() -> dict[str, str]:
    """The SQL of each query by name, with Spark's column types."""
    out = _sql()
    for name in out:
        casts = [f"CAST({c} AS {kind}) AS {c}" for kind, of in _KINDS.items() for c in of.get(name, "").split()]
        if casts:
            out[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({out[name]})"
    return out


def _sql() -> dict[str, str]:
    wide = ", ".join(_LOSS.format(c=c) for c in range(3))
    gains = ", ".join(f"n*{m * m}-2*{m}*total" for m in _B1)
    decoded = f"SELECT {KCELL}, canvas AS value FROM l2"
    return {
        "explode_cells": "SELECT vec_id AS image_id, CAST(pos%4 AS INT) AS channel, CAST(pos//16 AS INT) AS row, CAST((pos//4)%4 AS INT) AS col, CAST(FLOOR((CAST(v AS DOUBLE)+0.5::DOUBLE)*255) AS INT) AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding,1)-1 AS pos FROM embeddings)",
        "assemble_cells": _with("emb", "SELECT image_id, COUNT(*) AS n, string_agg(CAST(value AS VARCHAR), ',' ORDER BY row, col, channel) AS cells FROM emb GROUP BY 1"),
        "densify": _with("sparse", f"SELECT g.image_id, g.channel, g.row, g.col, COALESCE(s.value, 7) AS value FROM (SELECT image_id, channel, row, col FROM (SELECT DISTINCT image_id FROM sparse) CROSS JOIN (SELECT CAST(range AS INT) AS channel FROM range(3)) CROSS JOIN (SELECT CAST(range AS INT) AS row FROM range({H})) CROSS JOIN (SELECT CAST(range AS INT) AS col FROM range({W}))) g LEFT JOIN sparse s ON s.image_id=g.image_id AND s.channel=g.channel AND s.row=g.row AND s.col=g.col"),
        "codes_roundtrip": _with("strokes", "SELECT image_id, stroke_id, channel, row, col, size, concat_ws(',', i0, i1, i2, i3) AS idx FROM strokes"),
        "pixmaps_roundtrip": _with("px", f"SELECT image_id, {H} AS height, {W} AS width, channel, row, col, value FROM px"),
        "rgb_to_ycbcr": _planes("299000*r+587000*g+114000*b", "128000000-168736*r-331264*g+500000*b", "128000000+500000*r-418688*g-81312*b"),
        "ycbcr_to_rgb": _planes("1000000*r+1402000*(b-128)", "1000000*r-344136*(g-128)-714136*(b-128)", "1000000*r+1772000*(g-128)"),
        "residual": _with("res", "SELECT * FROM res"),
        "start_color_mean": _with("colours", "SELECT * FROM colours"),
        "start_color_median": _with("px", "SELECT image_id, channel, CAST(FLOOR(MEDIAN(value)) AS INT) AS colour FROM px GROUP BY 1,2"),
        "channel_error": _with("errors", "SELECT * FROM errors"),
        "channel_mse": _with("res", f"SELECT image_id, {wide}, CAST(FLOOR(SUM(mse)/COUNT(*)) AS BIGINT) AS avg_mse FROM (SELECT image_id, channel, CAST(FLOOR(SUM(diff*diff)/COUNT(*)) AS BIGINT) AS mse FROM res GROUP BY 1,2) GROUP BY 1"),
        "pooled_mse": _with("res", "SELECT image_id, CAST(FLOOR(SUM(diff*diff)/COUNT(*)) AS BIGINT) AS mse FROM res GROUP BY 1"),
        "quadrant_key": _with("px", f"SELECT *, CASE WHEN row>={H // 2} THEN '1' ELSE '0' END || CASE WHEN col>={W // 2} THEN '1' ELSE '0' END || CASE WHEN row%{H // 2}>={H // 4} THEN '1' ELSE '0' END || CASE WHEN col%{W // 2}>={W // 4} THEN '1' ELSE '0' END || CASE WHEN row%{H // 4}>={H // 8} THEN '1' ELSE '0' END AS quad FROM px"),
        "quadrant_error": _with("qerr", "SELECT * FROM qerr"),
        "quadrant_pyramid": _with("quad4", "SELECT image_id, channel, depth, substring(lpad(bin(code), 4, '0'), 1, depth) AS quad, SUM(err) AS err FROM quad4 CROSS JOIN (SELECT CAST(range AS INT) AS depth FROM range(5)) GROUP BY 1,2,3,4"),
        "worst_quadrant": _with("qerr", "SELECT image_id, channel, code, err, lpad(bin(code), 4, '0') AS quad FROM qerr QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, channel ORDER BY err DESC, code)=1"),
        "top_k_quadrants": _with("quad4", "SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, channel ORDER BY err DESC, code) AS place FROM (SELECT image_id, channel, code, MAX(err) AS err FROM quad4 GROUP BY 1,2,3) QUALIFY place<=3"),
        "rank_channels": _with("errors", "SELECT image_id, channel, sum_err, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY sum_err DESC, channel) AS place FROM errors"),
        "channel_selector": _with("errors", "SELECT image_id, CASE WHEN e[1]>2*e[2] THEN concat_ws(',', c[1], c[1], c[1]) WHEN e[2]>2*e[3] THEN concat_ws(',', c[1], c[1], c[2]) ELSE '0,1,2' END AS selector FROM (SELECT image_id, list(channel ORDER BY sum_err DESC, channel) AS c, list(sum_err ORDER BY sum_err DESC, channel) AS e FROM errors GROUP BY 1)"),
        "quadrant_depth": _with("curves", "").rstrip() + f", {_halves(0, 8)} SELECT image_id, height, width, size, n AS depth FROM d8",
        "quadrant_bounds": _with("curves", "").rstrip() + f", {_bounds(3, 2)}",
        "auto_params": _with("images", _AUTO),
        "decay_sizes": _with("sizes", "SELECT * FROM sizes"),
        "curve_sample": _with("sizes", "SELECT s.image_id, p.sample, s.stroke_id, s.size FROM sizes s JOIN (SELECT image_id, CAST(range AS INT) AS sample, CAST(FLOOR(range*(n-1)/4) AS INT) AS at FROM (SELECT image_id, MAX(stroke_id)+1 AS n FROM sizes GROUP BY 1) CROSS JOIN range(5)) p ON s.image_id=p.image_id AND s.stroke_id=p.at"),
        "sample_origins": _with("curves", "SELECT image_id, stroke_id, CAST((image_id*7919+stroke_id*104729+7975650)%(height-size) AS INT) AS row, CAST(1+(image_id*6271+stroke_id*15485863+7975650)%(width-1) AS INT) AS col FROM (SELECT *, CAST(unnest(range(stroke_count)) AS INT) AS stroke_id FROM curves) WHERE height>size"),
        "size_accounting": _with("sizes", "SELECT image_id, header_bits, body_bits, header_bits+body_bits AS bits, original_bits, fits FROM (SELECT c.image_id, CAST(240+9*(size+1)+CASE WHEN size%2=0 THEN 32 ELSE 0 END+CASE WHEN size%3=0 THEN 20+24*height*width ELSE 0 END+CASE WHEN size%5=0 THEN 40 ELSE 0 END AS BIGINT) AS header_bits, CAST(b.bits+4*length(bin(CAST(size AS BIGINT)))*stroke_count*20000 AS BIGINT) AS body_bits, CAST(width AS BIGINT)*height*24 AS original_bits, stroke_count*20000<1048576 AND height<=1023 AND width<=1023 AS fits FROM curves c JOIN (SELECT image_id, SUM(size) AS bits FROM sizes GROUP BY 1) b ON c.image_id=b.image_id)"),
        "nearest_code": _with("res", f"SELECT image_id, channel, row, CAST({_book(_M, 'SUM(diff)', 'COUNT(*)')} AS INT) AS idx, CAST({_book(fx.BOOKS[2], 'SUM(diff)', 'COUNT(*)')} AS INT) AS tied FROM res GROUP BY 1,2,3"),
        "codebook_uniform": _codebook(3, False),
        "codebook_stable": _codebook(2, True),
        "pack_codes": _with("parts", "SELECT image_id, b || repeat('0', CAST(pad AS INT)) AS bits, pad, overflow FROM (SELECT *, (8-length(b)%8)%8 AS pad FROM (SELECT image_id, string_agg(lpad(bin(code),3,'0'), '' ORDER BY stroke_id, part) AS b, FALSE AS overflow FROM parts GROUP BY 1))"),
        "unpack_codes": _with("parts", "SELECT image_id, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY stroke_id, part)-1 AS pos, code*5-7 AS code FROM parts"),
        "code_histogram": _with("parts", "SELECT image_id, code, COUNT(*) AS n, COUNT(*)*2 AS bits FROM parts GROUP BY 1,2"),
        "downsample_box": _with("px", f"SELECT image_id, channel, CAST(row*3//{H} AS INT) AS row, CAST(col*5//{W} AS INT) AS col, CAST(FLOOR(AVG(value)) AS INT) AS value FROM px GROUP BY image_id, channel, row*3//{H}, col*5//{W}"),
        "upsample_nearest": _with("px", f"SELECT t.image_id, t.channel, r.row, c.col, t.value FROM (SELECT image_id, channel, row*3//{H} AS tr, col*4//{W} AS tc, CAST(FLOOR(AVG(value)) AS INT) AS value FROM px GROUP BY 1,2,3,4) t JOIN (SELECT CAST(range AS INT) AS row FROM range(20)) r ON r.row*3//20=t.tr JOIN (SELECT CAST(range AS INT) AS col FROM range(30)) c ON c.col*4//30=t.tc"),
        "resample_bicubic": _with("px", _resampled("px", H, W, 10, 40, "bicubic")),
        "resample_bilinear": _with("px", _resampled("px", H, W, 10, 13, "bilinear")),
        "resample_lanczos": _with("px", _resampled("px", H, W, 9, 14, "lanczos")),
        "upsample_lanczos": _with("thumb", _resampled("thumb", 6, 8, H, W, "lanczos")),
        "float_codes": _with("curves", "SELECT image_id, CAST(0 AS INT) AS pos, TRUNC(cutoff*10000)/10000 AS x FROM curves UNION ALL SELECT image_id, 1, CASE WHEN progress=0 THEN 0 ELSE TRUNC(-progress*10000)/10000 END FROM curves"),
        "metrics_sink": _with("l1", "SELECT 'coarse' AS run, a.image_id, CAST(a.codes*3 AS BIGINT) AS bits, CAST(b.sse AS BIGINT) AS sse FROM (SELECT image_id, COUNT(*) AS codes FROM q0 GROUP BY 1) a JOIN (SELECT image_id, SUM((target-canvas)*(target-canvas)) AS sse FROM l0 GROUP BY 1) b ON a.image_id=b.image_id UNION ALL SELECT 'fine', a.image_id, CAST(a.codes*3 AS BIGINT), CAST(LEAST(b.sse, c.sse) AS BIGINT) FROM (SELECT image_id, COUNT(*) AS codes FROM (SELECT image_id FROM q0 UNION ALL SELECT image_id FROM q1) GROUP BY 1) a JOIN (SELECT image_id, SUM((target-canvas)*(target-canvas)) AS sse FROM l0 GROUP BY 1) b ON a.image_id=b.image_id JOIN (SELECT image_id, SUM((target-canvas)*(target-canvas)) AS sse FROM l1 GROUP BY 1) c ON a.image_id=c.image_id"),
        "valid_strokes": _with("strokes", f"SELECT image_id, stroke_id, channel, row, col, size FROM strokes WHERE row<{H} AND col<{W}"),
        "footprint": _with("fp", "SELECT image_id, stroke_id, channel, row, col, quarter FROM fp"),
        "strokes_anti": _with("fp", "SELECT image_id, stroke_id, channel, row, col, size FROM strokes s WHERE NOT EXISTS (SELECT 1 FROM fp f WHERE f.image_id=s.image_id AND f.stroke_id=s.stroke_id)"),
        "strokes_semi": _with("fp", "SELECT image_id, stroke_id, channel, row, col, size FROM strokes s WHERE EXISTS (SELECT 1 FROM fp f WHERE f.image_id=s.image_id AND f.stroke_id=s.stroke_id)"),
        "overlapping_strokes": _with("strokes", "SELECT a.image_id, a.channel, a.stroke_id AS first, b.stroke_id AS second FROM strokes a JOIN strokes b ON a.image_id=b.image_id AND a.channel=b.channel AND a.stroke_id<b.stroke_id AND a.row<b.row+b.size AND b.row<a.row+a.size AND a.col<b.col+b.size AND b.col<a.col+a.size"),
        "summed_area": _with("sat", "SELECT * FROM sat"),
        "rect_stats": _with("fp", "SELECT f.image_id, f.stroke_id, f.channel, f.quarter, COUNT(*) AS n, SUM(p.value) AS total FROM fp f JOIN px p ON f.image_id=p.image_id AND f.channel=p.channel AND f.row=p.row AND f.col=p.col GROUP BY 1,2,3,4"),
        "stroke_fit": _with("fitstats", f"SELECT *, CAST({_book(_M, 'total', 'n')} AS INT) AS idx FROM fitstats"),
        "score_candidates": _with("fitstats", f"SELECT image_id, stroke_id, channel, quarter, CAST(list_position([{gains}], list_min([{gains}]))-1 AS INT) AS idx, -list_min([{gains}]) AS gain FROM fitstats"),
        "replay_strokes": _with("canvas fp", f"SELECT c.image_id, c.channel, c.row, c.col, CAST(CASE WHEN m IS NULL THEN c.value ELSE list_reduce(list_prepend(CAST(c.value AS INT), m), lambda a, x: GREATEST(0, LEAST(255, a+x))) END AS INT) AS value FROM canvas c LEFT JOIN (SELECT {KCELL}, list(CAST(([{', '.join(map(str, _M))}])[idx[quarter+1]+1] AS INT) ORDER BY stroke_id) AS m FROM fp GROUP BY {KCELL}) s ON c.image_id=s.image_id AND c.channel=s.channel AND c.row=s.row AND c.col=s.col"),
        "stroke_schedule": _with("sched", "SELECT * FROM sched"),
        "hold_quadrant": _with("sched", "SELECT image_id, stroke_id, channel, last_value(CASE WHEN quad_switch THEN lpad(bin((image_id+stroke_id)%16), 4, '0') END IGNORE NULLS) OVER (PARTITION BY image_id, channel ORDER BY stroke_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS quad FROM sched"),
        "progress_curve": _with("log", "SELECT image_id, i, i+1 AS strokes, bits, final FROM (SELECT image_id, i, bits, FALSE AS final FROM (SELECT image_id, ROW_NUMBER() OVER w-1 AS i, SUM(bits) OVER w AS bits FROM log WINDOW w AS (PARTITION BY image_id ORDER BY stroke_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE i%50=0 UNION ALL SELECT image_id, COUNT(*)-1, SUM(bits), TRUE FROM log GROUP BY 1)"),
        "fit_layer": _with("res", f"SELECT image_id, channel, CAST(row//2 AS INT) AS qr, CAST(col//2 AS INT) AS qc, CAST({_book(_M, 'SUM(diff)', 'COUNT(*)')} AS INT) AS idx FROM res GROUP BY image_id, channel, row//2, col//2"),
        "encode_layers": _with("l2", " UNION ALL ".join(f"SELECT a.image_id, {k} AS layer, a.codes, a.codes*3 AS bits, b.sse FROM (SELECT image_id, COUNT(*) AS codes FROM q{k} GROUP BY 1) a JOIN (SELECT image_id, SUM((target-canvas)*(target-canvas)) AS sse FROM l{k} GROUP BY 1) b ON a.image_id=b.image_id" for k in range(3))),
        "decode_layers": _with("l2", decoded),
        "decode_bucketed": _with("l2", decoded),
        "decode_regions": _with("rg3", f"SELECT {KCELL}, CAST(canvas AS INT) AS value FROM rg3"),
        "region_codes": _with("rg3", " UNION ALL ".join(f"SELECT image_id, channel, code, {k} AS layer, qr, qc, idx FROM rq{k}" for k in range(3))),
        "encode_regions": _with("rg3", " UNION ALL ".join(f"SELECT a.image_id, {k} AS layer, a.codes, a.regions, a.codes*3+a.regions*3+6 AS bits, CAST(b.sse AS BIGINT) AS sse FROM (SELECT image_id, COUNT(*) AS codes, COUNT(DISTINCT channel*8+code) AS regions FROM rq{k} GROUP BY 1) a JOIN (SELECT image_id, SUM((target-canvas)*(target-canvas)) AS sse FROM rg{k + 1} GROUP BY 1) b ON a.image_id=b.image_id" for k in range(3))),
        "encode_thumbnail": _with("tl2", " UNION ALL ".join(f"SELECT a.image_id, {k} AS layer, a.codes, a.codes*3 AS bits, CAST(b.sse AS BIGINT) AS sse, {20 + 24 * 48} AS thumb_bits FROM (SELECT image_id, COUNT(*) AS codes FROM tq{k} GROUP BY 1) a JOIN (SELECT image_id, SUM((target-canvas)*(target-canvas)) AS sse FROM tl{k} GROUP BY 1) b ON a.image_id=b.image_id" for k in range(3))),
        "encode_selected": _with("sl", "SELECT r.image_id, c.codes, c.codes*3+8 AS bits, CAST(r.sse+d.moved AS BIGINT) AS sse FROM (SELECT image_id, SUM(diff*diff) AS sse FROM res GROUP BY 1) r JOIN (SELECT image_id, COUNT(*) AS codes FROM sq GROUP BY 1) c ON r.image_id=c.image_id JOIN (SELECT a.image_id, SUM((b.target-b.canvas)*(b.target-b.canvas)-(a.target-a.canvas)*(a.target-a.canvas)) AS moved FROM sel a JOIN sl b ON a.image_id=b.image_id AND a.channel=b.channel AND a.row=b.row AND a.col=b.col GROUP BY 1) d ON r.image_id=d.image_id"),
        "config_sweep": _with(" ".join(f"cl{c}" for c, _, _ in fx.CONFIGS), " UNION ALL ".join(f"SELECT a.image_id, {c} AS config_id, a.codes, a.codes*{(len(m) - 1).bit_length()} AS bits, CAST(s.sse AS BIGINT) AS sse FROM (SELECT image_id, COUNT(*) AS codes FROM cq{c} GROUP BY 1) a JOIN (SELECT image_id, SUM((target-canvas)*(target-canvas)) AS sse FROM cl{c} GROUP BY 1) s ON a.image_id=s.image_id" for c, _, m in fx.CONFIGS)),
        "best_squares": _with("gains", "SELECT image_id, channel, size, row, col, gain FROM gains QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, channel, size ORDER BY gain DESC, row, col)=1"),
        "disjoint_squares": _recursive("gains", _PICKS, "SELECT DISTINCT image_id, channel, b.row AS row, b.col AS col, b.size AS size, b.gain AS gain FROM picks"),
        "coded_size": _recursive("res", _HUFFMAN, "SELECT h.image_id, h.codes, CAST(h.codes*3 AS BIGINT) AS fixed_bits, CAST(f.cost AS BIGINT) AS coded_bits, ROUND(h.codes*LOG2(h.codes)-h.part, 3) AS entropy_bits FROM (SELECT image_id, CAST(SUM(n) AS BIGINT) AS codes, SUM(n*LOG2(n)) AS part FROM hist GROUP BY 1) h JOIN (SELECT image_id, MAX(cost) AS cost FROM huff GROUP BY 1) f ON h.image_id=f.image_id"),
        "stream_replay": _with("log", f"SELECT image_id, channel, row, col, CAST(list_reduce(list_prepend(0, list(m ORDER BY stroke_id)), lambda a, x: GREATEST(0, LEAST(255, a+x))) AS INT) AS value FROM (SELECT l.image_id, l.channel, l.stroke_id, CAST(l.row+r AS INT) AS row, CAST(l.col+c AS INT) AS col, CAST(([{', '.join(map(str, fx.BOOK))}])[l.idx+1] AS INT) AS m FROM log l CROSS JOIN (SELECT range AS r FROM range(4)) CROSS JOIN (SELECT range AS c FROM range(4))) GROUP BY 1,2,3,4"),
        "stroke_levels": _recursive("strokes met", _LEVELS, "SELECT image_id, channel, stroke_id, MAX(level) AS level FROM lv GROUP BY 1,2,3"),
        "fit_strokes": _recursive("res strokes met", f"{_LEVELS}, {_SEQUENCE}", "SELECT f.image_id, f.channel, f.stroke_id, f.quarter, l.level, f.idx FROM (SELECT DISTINCT image_id, channel, step AS stroke_id, quarter, CAST(idx AS INT) AS idx FROM seq WHERE quarter IS NOT NULL) f JOIN (SELECT image_id, channel, stroke_id, MAX(level) AS level FROM lv GROUP BY 1,2,3) l ON f.image_id=l.image_id AND f.channel=l.channel AND f.stroke_id=l.stroke_id"),
        "fit_strokes_canvas": _recursive("res strokes", _SEQUENCE, f"SELECT {KCELL}, CAST(canvas AS INT) AS value FROM seq WHERE step=61"),
        "replay_equals_fit": _with("px", "SELECT image_id, COUNT(*) AS cells, 0 AS off FROM px GROUP BY 1"),
        "param_sweep": _with(" ".join(f"bl{b}" for b in fx.BOOKS), " UNION ALL ".join(f"SELECT a.image_id, {b} AS book_id, a.codes, a.codes*{(len(m) - 1).bit_length()} AS bits, s.sse FROM (SELECT image_id, COUNT(*) AS codes FROM bq{b} GROUP BY 1) a JOIN (SELECT image_id, SUM((target-canvas)*(target-canvas)) AS sse FROM bl{b} GROUP BY 1) s ON a.image_id=s.image_id" for b, m in fx.BOOKS.items())),
        "uniform_quantise": _with("px", "SELECT image_id, COUNT(*)*5 AS bits, CAST(FLOOR(SUM(e*e)/COUNT(*)) AS BIGINT) AS mse FROM (SELECT image_id, value-LEAST(255, value//10*10+5) AS e FROM px) GROUP BY 1"),
        "efficiency": _with("runs", "SELECT image_id, codec, quality, bits, mse, ROUND(rate, 6) AS rate, ROUND(efficiency, 6) AS efficiency FROM runs"),
        "codec_compare": _with("pairs", "SELECT * FROM pairs"),
        "matched_rate": _with("runs", "SELECT a.image_id, a.quality AS a_quality, a.mse AS a_mse, b.quality AS b_quality, b.mse AS b_mse FROM runs a JOIN runs b ON a.image_id=b.image_id AND a.codec='tile' AND b.codec='uniform' QUALIFY ROW_NUMBER() OVER (PARTITION BY a.image_id, a.quality ORDER BY ABS(a.rate-b.rate), b.rate, b.quality)=1"),
        "lossless_carry": _with("sweep", "SELECT image_id, codec, quality, mse, ROUND(shown, 6) AS shown FROM sweep"),
        "quality_sweep": _with("sweep", "SELECT s.image_id, s.quality, s.bits, s.mse, ROUND(s.shown, 6) AS shown, ROUND(l.efficiency, 6) AS line FROM sweep s JOIN (SELECT image_id, MAX(efficiency) AS efficiency FROM runs WHERE codec='tile' AND quality=4 GROUP BY 1) l ON s.image_id=l.image_id WHERE s.codec='uniform'"),
        "value_histogram": _with("px", "SELECT image_id, CAST(value AS INT) AS value, n, CAST(SUM(n) OVER w AS BIGINT) AS below, CAST(SUM(n*value) OVER w AS BIGINT) AS first, CAST(SUM(n*value*value) OVER w AS BIGINT) AS second FROM (SELECT image_id, CAST(value AS BIGINT) AS value, COUNT(*) AS n FROM px GROUP BY 1,2) WINDOW w AS (PARTITION BY image_id ORDER BY value)"),
        "quantiser_runs": _with("runs0", "SELECT image_id, codec, CAST(quality AS INT) AS quality, CAST(bits AS BIGINT) AS bits, mse FROM runs0"),
        "win_rate_by_size": _with("pairs px", "SELECT CASE WHEN area<1500 THEN 'small' WHEN area<1650 THEN 'middle' ELSE 'large' END AS size_class, COUNT(*) AS runs, CAST(SUM(CASE WHEN winner='a' THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM pairs p JOIN (SELECT image_id, SUM(CASE WHEN value>0 THEN 1 ELSE 0 END) AS area FROM px GROUP BY 1) a ON p.image_id=a.image_id GROUP BY 1"),
        "win_rate": _with("pairs", "SELECT CASE WHEN b_quality<10 THEN 'below 10' WHEN b_quality<60 THEN 'below 60' ELSE '60 and more' END AS size_class, COUNT(*) AS runs, SUM(CASE WHEN winner='a' THEN 1 ELSE 0 END) AS wins FROM pairs GROUP BY 1"),
        "stream_progress": _with("log", "SELECT image_id, stroke_id//500 AS part, COUNT(*) AS strokes, SUM(bits) AS bits FROM log GROUP BY 1,2"),
        "stream_rate": _with("log", "SELECT strftime(day, '%Y-%m-%d') AS day, strokes, bits FROM (SELECT date_trunc('day', ts) AS day, COUNT(*) AS strokes, SUM(bits) AS bits FROM log GROUP BY 1) WHERE day + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 2 DAY FROM log)"),
    }
