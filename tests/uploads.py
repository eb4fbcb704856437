"""Own upload files for the tests, made by rule.

steady: deliveries that all succeed; slow: 8 of 10 attempts time out (health
19, not 20); bad_keys: 9 of 10 are signature failures, none a server error
(health 9); mixed: client and server errors, an empty status, a repeated
attempt, an event first seen at its third attempt; many: 120 rows over 5
endpoints with up to 4 attempts an event."""
import csv
import os

HEADER = ["event_id", "event_type", "customer_id", "endpoint_id", "attempt_number", "http_status",
          "response_time_ms", "timeout", "signature_valid"]
KINDS = ["invoice.created", "invoice.paid", "compliance.failed", "compliance.submitted"]


def row(event, endpoint, attempt, status, ms, timeout=False, signature=True, kind=0):
    return [f"w-{event}", KINDS[kind % len(KINDS)], f"firm{endpoint}", f"hook{endpoint}", str(attempt), str(status),
            str(ms), str(timeout), str(signature)]


def steady():
    return [row(f"s{i}", i % 3, 1, 200 + i % 2, 90 + 7 * i, kind=i) for i in range(12)]


def slow():
    return [row(f"t{i // 2}", i // 5, 1 + i % 2, 504 if i % 5 else 200, 4000 + i if i % 5 else 150, timeout=bool(i % 5), kind=i // 2)
            for i in range(10)]


def bad_keys():
    return [row(f"k{i}", 7, 1, 200 if i == 4 else 401, 40 + i, signature=i == 4, kind=i) for i in range(10)]


def mixed():
    return [row("m0", 1, 1, 404, 30), row("m0", 1, 2, 500, 31), row("m0", 1, 3, 200, 32), row("m1", 2, 3, 429, 33),
            row("m1", 2, 4, 201, 34), row("m2", 1, 1, "", 35), row("m3", 3, 1, 413, "", kind=2),
            row("m4", 2, 1, 503, 36, timeout=True), row("m4", 2, 1, 200, 37), row("m5", 3, 1, "x", 38)]


def many():
    out, x = [], 17
    for i in range(48):
        for attempt in range(1, 2 + i % 4):
            x = (x * 1103 + 12345) % 65536
            status = (200, 201, 401, 404, 429, 500, 503, 504)[x % 8]
            out.append(row(f"b{i}", i % 5, attempt, status, 100 + x % 5000, timeout=status == 504, signature=status != 401, kind=i))
    return out


FILES = {"steady.csv": steady, "slow.csv": slow, "bad_keys.csv": bad_keys, "mixed.csv": mixed, "many.csv": many}


def write(folder, name, columns=None, rows=None):
    """Write an upload, its columns in the given order; returns its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    order = columns or HEADER
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(order)
        for r in rows or FILES[name]():
            w.writerow([dict(zip(HEADER, r)).get(c, "") for c in order])
    return path
