"""The layout of late sales by brute force."""

import hashlib
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

EPOCH, CUTOFF = datetime(1970, 1, 1), datetime(2024, 3, 20)
COLUMNS = "sale_id,client_id,status,total,sold_at,arrived_at,priority"


def day_of(row):
    return -1 if row["sold_at"] is None else (row["sold_at"] - EPOCH).days


def micros(t):
    return "" if t is None else str((t - EPOCH) // timedelta(microseconds=1))


def days_of(rows):
    best = {}
    for r in rows:
        k = r["sale_id"]
        if k not in best or (r["arrived_at"] or datetime.min) > (best[k]["arrived_at"] or datetime.min):
            best[k] = r
    out = defaultdict(list)
    for r in best.values():
        out[day_of(r)].append(r)
    return {d: sorted(x, key=lambda r: (r["sold_at"] or datetime.min, -1 if r["sale_id"] is None else r["sale_id"])) for d, x in out.items()}, best


def expected(sales):
    """(n_rows, cents, rows_crc, columns, ids_sha256, rewritten) by (day, file_no)."""
    size, rows = 1 + len(sales) // 1100, []
    for r in sales:
        r = r.asDict()
        rows.append(r)
        h = None if r["sale_id"] is None else zlib.crc32(str(r["sale_id"]).encode())
        if h is not None and h % 3 == 0 and day_of(r) % 4 == 0:
            more = lambda t, n: None if t is None else t + timedelta(days=n)
            rows.append(r | {"total": None if r["total"] is None else r["total"] + 1, "sold_at": more(r["sold_at"], h % 2), "arrived_at": more(r["arrived_at"], 1 + h % 97)})
    is_early = lambda r: r["arrived_at"] is not None and r["arrived_at"] < CUTOFF
    _, start = days_of([r for r in rows if is_early(r)])
    final, best = days_of([r for r in rows if is_early(r)] + [r for r in rows if not is_early(r)])
    dirty = set()
    for k, r in best.items():
        if not is_early(r):
            dirty |= {day_of(r)} | ({day_of(start[k])} if k in start else set())
    out = {}
    for day, own in final.items():
        for n in range(0, len(own), size):
            part = own[n : n + size]
            crc = sum(zlib.crc32(f"{'' if r['sale_id'] is None else r['sale_id']}:{micros(r['sold_at'])}:{micros(r['arrived_at'])}".encode()) for r in part)
            cents = sum(0 if r["total"] is None else int((100 * r["total"] + 0.5) // 1) for r in part)
            ids = ",".join("" if r["sale_id"] is None else str(r["sale_id"]) for r in part)
            out[day, n // size] = len(part), cents, crc, COLUMNS, hashlib.sha256(ids.encode()).hexdigest(), day in dirty
    return out
