"""Sequential models of the inventory side, for comparison on small random data."""

from dataclasses import dataclass, field

from larder import config as C


@dataclass
class Kitchen:
    id: int
    owned: dict = field(default_factory=dict)  # slug -> expiring
    equipment: tuple = ()


@dataclass
class Recipe:
    id: int
    ordinal: int
    items: list  # (slug, optional) in order
    title: str = ""
    minutes: int = 10
    difficulty: str = "easy"
    cost: str = "cheap"
    equipment: tuple = ()
    tags: tuple = ()
    signature: str = ""
    use_count: int = 0


def holds(owned, slug, rules):
    return slug in owned or any(slug in c and any(m in owned for m in c) for c in rules.classes)


def cover(recipe, owned, rules):
    req = [s for s, opt in recipe.items if not opt and s not in rules.pantry_ignore]
    opt = [s for s, o in recipe.items if o]
    have = [s for s in req if holds(owned, s, rules)]
    miss = [s for s in req if not holds(owned, s, rules)]
    base, quick = rules.family
    fam = base in owned or quick in owned
    if fam:
        miss = [s for s in miss if s not in rules.family]
    need, got = len(req), len(have)
    if not req and any(s in rules.family for s in opt):
        need, got = need + 1, got + fam
    implied = any(s in rules.family for s, _ in recipe.items) and not any(s in rules.family for s in req)
    if implied:
        need, got = need + 1, got + fam
        if not fam:
            miss = miss + [base]
        else:
            form = quick if quick in owned else base
            have = list(dict.fromkeys([*have, form]))
    return {
        "have": have, "miss": list(dict.fromkeys(miss)),
        "opt_have": [s for s in opt if holds(owned, s, rules)],
        "opt_miss": [s for s in opt if not holds(owned, s, rules)],
        "pct": got / need if need else 1.0,
    }


def ready(c):
    return not c["miss"] and c["pct"] >= 0.999


def almost(c):
    return not ready(c) and len(c["miss"]) == 1 and c["pct"] >= 0.5


def score(recipe, kitchen, c, first_seen, rules, w=C.ScoreWeights()):
    slugs = [s for s, _ in recipe.items]
    n_wash = sum(e in C.WASHING_UP_ITEMS for e in recipe.equipment)
    nutrition = 0.4
    nutrition += 0.2 if rules.vegetable_tag in recipe.tags or any(s in rules.vegetables for s in slugs) else 0
    nutrition += 0.2 if any(s in rules.proteins for s in slugs) else 0
    nutrition += 0.15 if any(s in rules.carbs for s in slugs) else 0
    expiring = any(kitchen.owned.get(s) for s in slugs)
    fits = not kitchen.equipment or all(e == "" or e in kitchen.equipment for e in recipe.equipment)
    m = recipe.minutes
    terms = [
        c["pct"] * w.availability_pct,
        min(len(c["have"]) / 6, 1) * w.available_count,
        C.COST_SCORE[recipe.cost] * w.cost,
        (1 if m <= 10 else 0.8 if m <= 15 else 0.5 if m <= 25 else 0.25) * w.time,
        C.DIFFICULTY_SCORE.get(recipe.difficulty, 0.5) * w.difficulty,
        (1 if fits else 0.35) * w.equipment,
        {0: 1, 1: 1, 2: 0.7, 3: 0.4}.get(n_wash, 0.2) * w.washing_up,
        (1 if expiring else 0.35) * w.food_waste,
        (0.85 if first_seen else 0.2) * w.variety,
        (1 - min(recipe.use_count / 20, 0.8)) * w.exposure,
        min(nutrition, 1) * w.nutrition,
    ]
    total = 0.0
    for term in terms:  # plain left-to-right addition; sum() compensates
        total += term
    return total, expiring


def rank(recipes, kitchen, rules):
    seen, rows = set(), []
    for r in sorted(recipes, key=lambda r: r.ordinal):
        c = cover(r, kitchen.owned, rules)
        s, expiring = score(r, kitchen, c, r.signature not in seen, rules)
        seen.add(r.signature)
        rows.append({"r": r, "c": c, "score": s, "now": ready(c), "almost": almost(c), "exp": expiring})
    rows.sort(key=lambda x: (not x["now"], not x["exp"], -x["score"]))
    emitted, out, n_now = set(), [], 0
    for x in rows:
        key = "|".join(x["r"].signature.split("|")[:3])
        if key in emitted and x["now"] and n_now >= 4:
            x = {**x, "score": x["score"] * 0.92}
        emitted.add(key)
        n_now += x["now"]
        out.append(x)
    return sorted(out, key=lambda x: (-x["score"], not x["now"]))


def purchases(recipes, catalog, kitchen, rules):
    """catalog: list of dicts in order; every un-owned item against every recipe that lists it."""
    rows = []
    ordered = sorted(recipes, key=lambda r: r.ordinal)
    before = {r.id: cover(r, kitchen.owned, rules) for r in ordered}
    for item in catalog:
        slug = item["slug"]
        if slug in kitchen.owned or slug in rules.never_buy:
            continue
        listed = [r for r in ordered if any(s == slug for s, _ in r.items)]
        got = {"unlocked": [], "improved": [], "fancied": []}
        for r in listed:
            b = before[r.id]
            if ready(b):
                if slug in b["opt_miss"]:
                    got["fancied"].append(r.title)
                continue
            a = cover(r, {**kitchen.owned, slug: False}, rules)
            if ready(a):
                got["unlocked"].append(r.title)
            elif len(a["miss"]) < len(b["miss"]):
                got["improved"].append(r.title)
        if not any(got.values()) and not item["is_essential"]:
            continue
        u, i, f = (len(got[k]) for k in ("unlocked", "improved", "fancied"))
        effort = round(
            C.LOW_EFFORT_COST[item["cost_category"]] * 40 + min(item["shelf_life_days"] / 90, 1) * 25
            + item["versatility"] * 25 + (1 - item["waste_risk"]) * 10, 2,
        )
        rows.append({
            "slug": slug, "unlocked": u, "improved": i, "fancied": f, "titles": got, "ordinal": item["ordinal"],
            "score": u * 10 + i * 3 + f * 4 + min(item["shelf_life_days"] / 60, 1) * 6 + item["versatility"] * 8
            + C.COST_BONUS[item["cost_category"]] - item["waste_risk"] * 7,
            "super": effort >= 55 and (u >= 2 or f >= 2 or (u >= 1 and f >= 1))
            and item["cost_category"] in ("very_cheap", "cheap"),
            "super_score": u * 12 + f * 8 + i * 3 + effort * 0.35,
        })
    return sorted(rows, key=lambda x: (-x["score"], x["ordinal"]))


def bundle(recipes, catalog, kitchen, rules, count=3):
    best = purchases(recipes, catalog, kitchen, rules)[:20]
    held, picked = set(kitchen.owned), []
    for row in best:
        if len(picked) >= count:
            break
        groups = [g for g in rules.substitute_groups if row["slug"] in g]
        if row["slug"] in held or any(s in held for g in groups for s in g):
            continue
        picked.append(row)
        held.add(row["slug"])
    out = []
    for n, row in enumerate(picked):
        owned = {**kitchen.owned, **{p["slug"]: False for p in picked[:n]}}
        fresh = purchases(recipes, catalog, Kitchen(kitchen.id, owned, kitchen.equipment), rules)
        out.append(next((x for x in fresh if x["slug"] == row["slug"]), row))
    return out


def chain(owned, equipment, transforms, max_depth=4):
    parts, out = [], []
    for depth in range(1, max_depth + 1):
        grew = False
        for t in transforms:
            need = t.required
            if not need:
                continue
            plain = [i for i in need if i.role != "fat"]
            fats = [i for i in need if i.role == "fat"]
            if not all((i.ingredient in owned) if i.ingredient else (i.component in parts) for i in plain):
                continue
            if fats and not any(i.ingredient in owned for i in fats):
                continue
            if equipment and any(e and e not in equipment for e in t.equipment):
                continue
            if t.output_slug not in parts:
                parts.append(t.output_slug)
                out.append((t.output_slug, t.slug, depth))
                grew = True
        if not grew:
            break
    return out


def greedy_two_keys(rows):
    """rows: (ordinal, score, family, near)"""
    seen_f, seen_n, kept = set(), set(), []
    for o, s, f, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        if f in seen_f or n in seen_n:
            continue
        seen_f.add(f)
        seen_n.add(n)
        kept.append(o)
    return kept


def reservoir(rows, limit, hash_, prefer=True, only=False, is_pref=lambda s: s == "gathered"):
    """rows: (id, source) in order; ids of the sample in order."""
    box = {0: [], 1: []}
    n = {0: 0, 1: 0}
    for id_, source in rows:
        kind = 0 if is_pref(source) else 1
        if kind == 1 and only:
            continue
        slot = kind if (prefer or only) else 1
        n[slot] += 1
        pool = box[slot]
        if len(pool) < limit:
            pool.append(id_)
        else:
            j = int(hash_(f"{id_}:{n[slot]}") * n[slot])
            if j < limit:
                pool[j] = id_
    if not prefer and not only:
        return box[1][:limit]
    if len(box[0]) >= limit or only:
        return box[0][:limit]
    return box[0] + box[1][: limit - len(box[0])]
