"""Text reports."""

from __future__ import annotations


def _number(value, sign: str = "") -> str:
    return "null" if value is None else f"{value:{sign}.6f}" if isinstance(value, float) else str(value)


def catalog_text(entries: dict) -> str:
    if not entries:
        return "(no patterns found)"
    lines = []
    for category in sorted(entries):
        lines.append(f"=== {category} ===")
        for fingerprint, stats in sorted(entries[category].items()):
            spots = ", ".join(f"{x['file']}:{x['start_row']}:{x['start_col']}" for x in stats["locations"][:3])
            lines.append(f"  {fingerprint[:12]}… count:{stats['count']}" + (f" | {spots}" if spots else ""))
    return "\n".join(lines)


def snapshot_text(s: dict) -> str:
    rows = [("snapshot_version:", s["snapshot_version"]), ("timestamp:", s["timestamp"])]
    rows += [("commit:", s["commit"])] if s.get("commit") else []
    rows += [("nodes:", s["graph"]["node_count"]), ("edges:", s["graph"]["edge_count"]), ("density:", f"{s['graph']['density']:.6f}"), ("communities:", len(s["partition"]["stability"])), ("modularity:", f"{s['partition']['modularity']:.6f}"), ("pattern_categories:", len(s["catalog"]["entries"]))]
    if d := s.get("intent_divergence"):
        rows += [("boundaries:", d["boundary_count"]), ("violations:", d["violation_count"])]
    if (c := s.get("change_coupling")) is not None:
        top = "; ".join(f"({p['source']}, {p['target']}): {p['frequency']:.2f}" for p in c["pairs"][:5])
        rows.append(("change coupling:", f"{len(c['pairs'])} pairs" + (f" (top 5: {top})" if top else "")))
    return "\n".join(f"{name:<19}{value}" for name, value in rows)


def divergence_text(d: dict) -> str:
    return "\n".join(f"{k + ':':<25}{_number(d[k])}" for k in ("pattern_entropy_delta", "coupling_delta", "community_count_delta", "boundary_violation_delta"))


def check_text(summary: dict, breaches: list[dict], applied: dict) -> str:
    lines = [f"check: FAILED — {len(breaches)} threshold(s) exceeded" if breaches else "check: OK — all thresholds within limits"]
    for b in breaches:
        name = b["dimension"] + (f" [{b['category']}]" if b["category"] else "")
        lines.append(f"  {name}: {b['actual']:.6f} > {b['limit']:.6f} (limit)")
    if applied:
        lines += ["", "applied overrides:"]
        lines += [f"  {c}: active (expires {o['expires']})" if o["active"] else f"  {c}: inactive — {o['expired_reason'] or 'expired'}" for c, o in sorted(applied.items())]
    return "\n".join([*lines, "", divergence_text(summary)])


def trend_text(t: dict) -> str:
    names = ("pattern_entropy_slope", "convention_drift_slope", "coupling_slope", "community_count_slope")
    return "\n".join([f"snapshots in window: {t['snapshot_count']}", *(f"{n + ':':<25}{_number(t[n], '+')}" for n in names)])
