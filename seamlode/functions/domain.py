"""Normal forms of the domain: quantities, subjects, processes, materials, conditions of experiments.

Rules are tables; names are few against the rows that use them, so the rule functions are plain
Python over a text, run in Arrow batches, or once per different name by ``resolved``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quantity -> (what it measures, other names).
QUANTITIES = {
    "hardness": ("hardness_scale", ["твёрдость", "твердость", "hardness"]),
    "yield_strength": ("pressure", ["0.2 % proof stress", "предел текучести", "σ0.2", "YS"]),
    "tensile_strength": ("pressure", ["ultimate tensile strength", "предел прочности", "UTS", "σв"]),
    "elongation": ("ratio", ["total elongation to failure", "относительное удлинение", "At"]),
    "grain_size": ("length", ["average grain diameter", "размер зерна"]),
    "creep_rate": ("strain_rate", ["скорость ползучести"]),
    "electrode_potential": ("voltage", ["потенциал"]),
    "current_density": ("current_density", ["плотность тока"]),
    "recovery_degree": ("ratio", ["степень извлечения", "извлечение"]),
    "phase_fraction": ("ratio", ["доля фазы"]),
    "element_content": ("ratio", ["содержание элемента", "содержание"]),
    "melting_point": ("temperature", ["температура плавления"]),
    "viscosity": ("viscosity", ["вязкость"]),
    "dry_residue": ("mass_concentration", ["сухой остаток", "TDS", "total dissolved solids"]),
    "salinity": ("mass_concentration", ["минерализация", "общая минерализация", "солесодержание"]),
    "flow_rate": ("volumetric_flow", ["скорость потока", "расход", "flow rate", "циркуляция"]),
    "ph": ("dimensionless", ["pH", "рН", "кислотность"]),
    "energy_consumption": ("specific_energy", ["удельный расход энергии", "энергоёмкость", "kWh/t"]),
    "specific_cost": ("specific_cost", ["себестоимость", "удельные затраты"]),
    "capex": ("currency", ["капитальные затраты", "CAPEX"]),
    "opex": ("currency", ["операционные затраты", "OPEX"]),
    "current_efficiency": ("ratio", ["выход по току", "current efficiency"]),
    "temperature": ("temperature", ["температура", "temperature", "поле температуры"]),
    "pressure": ("pressure", ["давление", "pressure"]),
    "compressive_strength": ("pressure", ["предел прочности при сжатии", "прочность при одноосном сжатии", "compressive strength", "прочность на сжатие"]),
    "concentration": ("mass_concentration", ["концентрация", "concentration"]),
    "corrosion_rate": ("speed", ["скорость коррозии", "corrosion rate"]),
    "safety_factor": ("dimensionless", ["коэффициент запаса", "коэффициент запаса устойчивости", "коэффициенты запаса устойчивости", "safety factor"]),
    "stress": ("pressure", ["напряжение", "напряжения", "stress", "maximum principal stress", "главное напряжение"]),
    "strain": ("ratio", ["деформация", "деформации", "strain"]),
    "amplitude": ("length", ["амплитуда", "amplitude", "входная амплитуда", "выходная амплитуда"]),
    "period": ("time", ["период", "period"]),
    "area": ("area", ["площадь", "area"]),
    "diameter": ("length", ["диаметр", "diameter"]),
    "distance": ("length", ["расстояние", "distance"]),
    "particle_size": ("length", ["размер частиц", "средний размер частиц", "particle size", "d50", "крупность"]),
    "discharge_capacity": ("charge_capacity", ["разрядная ёмкость", "разрядная емкость", "discharge capacity", "discharge capacities"]),
    "gas_flow": ("volumetric_flow", ["расход газа", "gas flow", "дутьё", "blast velocity"]),
    "yield_fraction": ("ratio", ["выход", "yield"]),
    "efficiency": ("ratio", ["эффективность", "efficiency", "степень очистки"]),
    "solubility": ("mass_concentration", ["растворимость", "solubility"]),
    "redox_potential": ("voltage", ["овп", "окислительно-восстановительный потенциал", "redox potential", "orp"]),
    "frequency": ("frequency", ["частота", "frequency", "fluctuation frequency"]),
    "mass": ("mass", ["масса", "mass"]),
    "time_duration": ("time", ["время", "длительность", "time", "duration"]),
    "qualitative_observation": ("none", ["наблюдение", "observation"]),
}
# Names that say nothing, and a pattern of what is seen rather than measured.
NO_QUANTITY = {"string", "verbatim-string", "value", "число", "unknown", "n/a", "none", "property", "quantity", "параметр", "показатель", "performance"}
_SEEN = re.compile(r"appearance|внешний вид|форм[аы]|локализация|presence|наличие|foaming|вспенивание|характер|pattern|distortion|осадок$|поведение")
# Patterns of a quantity and its subject (group s), the special before the general.
_OF_SUBJECT = [(re.compile(p), kind) for p, kind in (
    (r".*(сжати|compressive).*", "compressive_strength"),
    (r"(?P<s>.*?)[_\s]*(давление|pressure)[_\s]*(?P<s2>.*)$", "pressure"),
    (r"(?:степень\s+)?извлечени[еяю]\s+(?P<s>.+?)(?:\s+в\s+.+)?$", "recovery_degree"),
    (r"(?P<s>\w+?)[_\s]extraction(?:[_\s].*)?$", "recovery_degree"),
    (r"extraction[_\s]of[_\s](?P<s>.+)$", "recovery_degree"),
    (r"содержани[ея]\s+(?P<s>.+?)(?:\s+в\s+.+)?$", "element_content"),
    (r"(?P<s>[a-zа-яё\d]+?)[_\s]content(?:[_\s].*)?$", "element_content"),
    (r"концентраци[яи]\s+(?P<s>.+)$", "concentration"),
    (r"(?:массовая\s+доля|доля)\s+(?P<s>.+)$", "phase_fraction"),
    (r"расход\s+(?P<s>.+)$", "flow_rate"),
    (r"(?P<s>.+?)[_\s]+(?:pulp[_\s])?flow$", "flow_rate"),
    (r"скорость\s+(?:потока\s+)?(?P<s>.+)$", "flow_rate"),
    (r"(?:потери|loss(?:es)?[_\s]of)\s*(?P<s>.+)$", "yield_fraction"),
    (r"выход\s+(?P<s>.+?)(?:,.*)?$", "yield_fraction"),
    (r"эффективность\s+(?P<s>.+)$", "efficiency"),
    (r"растворимость\s+(?P<s>.+)$", "solubility"),
    (r"температура\s+(?P<s>.+)$", "temperature"),
    (r"амплитуда\s+(?P<s>.+)$", "amplitude"),
    (r"(?:масса|mass[_\s]of)\s+(?P<s>.+)$", "mass"),
    (r"time[_\s]to[_\s](?P<s>.+)$", "time_duration"),
    (r"время\s+(?P<s>.+)$", "time_duration"),
)]
# Units that tell the quantity.
_BY_UNIT = [(re.compile(p, re.I), kind) for p, kind in (
    (r"^HV\d*$|^HRC$|^HR[AB]$|^HB$|^HK$", "hardness"), (r"^(мг|г|kg|кг)/(л|дм3|дм³|m3|м3|м³)$", "concentration"), (r"^(м3|м³|m3)/(ч|час|h)$", "flow_rate"),
    (r"^°?[CС]$|^K$|^К$", "temperature"), (r"^(мкм|um|µm|нм|nm|мм)$", "particle_size"),
)]
# Stems of subjects -> symbol.
SUBJECTS = {
    "никел": "Ni", "nickel": "Ni", "ni": "Ni", "мед": "Cu", "copper": "Cu", "cu": "Cu", "кобальт": "Co", "cobalt": "Co", "co": "Co", "желез": "Fe", "iron": "Fe", "fe": "Fe",
    "мышьяк": "As", "arsenic": "As", "as": "As", "сер": "S", "sulfur": "S", "sulphur": "S", "s": "S", "кислород": "O", "oxygen": "O", "o2": "O",
    "золот": "Au", "gold": "Au", "au": "Au", "серебр": "Ag", "silver": "Ag", "ag": "Ag", "платин": "Pt", "platinum": "Pt", "pt": "Pt",
    "паллад": "Pd", "palladium": "Pd", "pd": "Pd", "род": "Rh", "rhodium": "Rh", "rh": "Rh", "цинк": "Zn", "zinc": "Zn", "zn": "Zn",
    "свинц": "Pb", "свинец": "Pb", "lead": "Pb", "pb": "Pb", "магни": "Mg", "magnesium": "Mg", "mgo": "MgO", "mg": "Mg", "кремни": "Si", "silicon": "Si", "sio2": "SiO2", "si": "Si",
    "кальци": "Ca", "calcium": "Ca", "ca": "Ca", "углерод": "C", "carbon": "C", "хром": "Cr", "chromium": "Cr", "cr": "Cr",
    "мпг": "PGM", "pgm": "PGM", "платиноид": "PGM", "пм": "PGM", "дм": "precious", "драгоценн": "precious", "цм": "non-ferrous", "цветн": "non-ferrous",
}
_EMPTY_WORDS = {"металл", "металла", "металлов", "metals", "metal", "в", "of", "и", "суммы", "сумма"}
_OF_ELEMENTS = {"recovery_degree", "element_content", "phase_fraction", "concentration", "solubility", "yield_fraction", "mass"}
# Process -> other names.
PROCESSES = {
    "desalination": ["обессоливание", "опреснение", "desalination", "деминерализация"], "water_treatment": ["водоподготовка", "очистка воды", "water treatment"],
    "electroextraction": ["электроэкстракция", "электролиз", "electrowinning", "циркуляция католита"], "injection": ["закачка", "закачка шахтных вод", "обратная закачка", "injection"],
    "smelting": ["плавка", "smelting"], "converting": ["конвертирование", "converting"], "flotation": ["флотация", "flotation"], "leaching": ["выщелачивание", "leaching"],
    "chlorination": ["хлорирование", "гидрохлорирование", "chlorination"], "precipitation": ["осаждение", "соосаждение", "precipitation"],
    "fire_refining": ["огневое рафинирование", "fire refining"], "casting": ["литьё", "литье", "розлив", "casting"], "annealing": ["отжиг", "annealing"], "extrusion": ["экструзия", "extrusion"],
}
# Words of a name -> family of materials, in the order in which they are tried.
FAMILIES = [
    ("концентрат", "concentrate"), ("штейн", "matte"), ("файнштейн", "fine_matte"), ("шлак", "slag"), ("раствор", "solution"), ("электролит", "solution"), ("вода", "solution"),
    ("кислота", "reagent"), ("реагент", "reagent"), ("сульфит", "reagent"), ("флюс", "reagent"), ("уголь", "reagent"), ("руда", "ore"), ("сплав", "alloy"), ("сталь", "steel"),
    ("анод", "metal"), ("катод", "metal"), ("осадок", "solid"), ("газ", "gas"),
]
# Stems that tell materials of one kind apart.
QUALIFIERS = [
    "медн", "никелев", "кобальтов", "железн", "цинков", "свинцов", "оловян", "сульфидн", "оксидн", "окисленн", "хлоридн", "сульфатн", "карбонатн",
    "анодн", "катодн", "чернов", "рафинирован", "элементн", "металлическ", "магнитн", "немагнитн", "силикатн", "шлаков", "штейнов", "колчеданн",
    "полиметаллическ", "молибден", "серосульфидн", "автоклавн", "богат", "бедн", "упорн", "низкосортн", "высокосортн", "рудн", "концентратн",
]
# Atmospheres and ways of cooling as written -> name.
TREATMENTS = {
    "vacuum": "vacuum", "in vacuum": "vacuum", "vac": "vacuum", "вакуум": "vacuum", "argon": "argon", "ar": "argon", "аргон": "argon", "nitrogen": "nitrogen", "n2": "nitrogen", "азот": "nitrogen",
    "air": "air", "воздух": "air", "furnace cool": "furnace cooling", "furnace cooled": "furnace cooling", "fc": "furnace cooling",
    "air cool": "air cooling", "air cooled": "air cooling", "ac": "air cooling", "water quench": "water quenching", "water quenched": "water quenching", "wq": "water quenching",
}


@cache
def _quantity_names() -> dict[str, str]:
    return {a.strip().lower().replace("_", " "): name for name, (_, others) in QUANTITIES.items() for a in (name, *others)}


@cache
def _process_names() -> dict[str, str]:
    return {a.lower(): name for name, others in PROCESSES.items() for a in (name, *others)}


def subject(raw: str | None) -> str | None:
    """Symbols of the elements that a subject names, joined by +, in order; without any its words."""
    if not raw:
        return None
    symbols, others = [], []
    for word in (w.strip(" .()[]") for w in re.split(r"[\s,_/]+", raw.strip().lower())):
        if word and word not in _EMPTY_WORDS:
            stem = max((s for s in SUBJECTS if word.startswith(s) and len(word) - len(s) <= 3), key=len, default=None)
            (others if stem is None else symbols).append(word if stem is None else SUBJECTS[stem])
    return "+".join(dict.fromkeys(symbols)) if symbols else " ".join(others)[:60] or None


def quantity(raw: str | None, unit: str | None = "") -> tuple[str | None, str | None, str, float]:
    """(kind, subject, method, confidence) of a measured name: junk, its own name, an observation, a kind of a subject, a name inside, the unit, or unresolved."""
    name = re.sub(r"\s*\(.*?\)\s*", " ", (raw or "").strip().lower().replace("_", " ").replace("‑", "-"))
    name = re.sub(r"\s+", " ", name).strip(" .,;")
    names = _quantity_names()
    if name in NO_QUANTITY or len(name) < 3:
        return None, None, "junk", 0.0
    if name in names:
        return names[name], None, "exact", 1.0
    if _SEEN.search(name):
        return "qualitative_observation", raw.strip()[:80], "qualitative", 0.8
    for pattern, kind in _OF_SUBJECT:
        if m := pattern.match(name):
            of = (m.groupdict().get("s") or "").strip()[:60] or None
            of = None if of in ("элемента", "элементов", "компонентов") else of
            return kind, subject(of) if kind in _OF_ELEMENTS else of, "pattern", 0.9
    inside = max((a for a in names if len(a) > 6 and a in name), key=len, default=None)
    if inside is not None:
        return names[inside], name.replace(inside, "").strip(" -—:")[:60] or None, "pattern", 0.8
    for pattern, kind in _BY_UNIT:
        if unit and pattern.match(unit.strip()):
            return kind, raw.strip()[:60], "unit", 0.7
    return None, None, "unresolved", 0.0


def process(raw: str | None) -> str:
    """Name of a process by one of its names, or by one of over four letters that it holds or is part of; else other."""
    key, names = (raw or "").strip().lower(), _process_names()
    if not key:
        return "other"
    return names.get(key) or next((name for a, name in names.items() if len(a) > 4 and (a in key or key in a)), "other")


def treatment(raw: str) -> str:
    """An atmosphere or treatment in one form: degree signs mended, lower case but for the scale's letter."""
    t = re.sub(r"(\d[\d.]*)\s*[oO]([CcFf])\b", lambda m: f"{m[1]}°{m[2].upper()}", raw.strip())
    t = re.sub(r" {2,}", " ", re.sub(r"\s*°\s*([CFKcfk])\b", lambda m: "°" + m[1].upper(), t)).lower()
    t = re.sub(r"°([cf])", lambda m: "°" + m[1].upper(), t)
    return TREATMENTS.get(t, t)


def _per_text(kind: str, f):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map({x: f(x) for x in b.unique()})

    return run


def subject_of(name: Column) -> Column:
    return _per_text("string", subject)(name)


def process_of(name: Column) -> Column:
    return _per_text("string", process)(name)


def treatment_of(name: Column) -> Column:
    return _per_text("string", lambda x: None if x is None else treatment(x))(name)


def quantity_of(name: Column, unit: Column) -> Column:
    """struct(kind, subject, method, confidence) of a name with its unit."""

    @F.pandas_udf("struct<kind:string,subject:string,method:string,confidence:double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, units in batches:
            yield pd.DataFrame([quantity(n, u) for n, u in zip(names, units)], columns=["kind", "subject", "method", "confidence"])

    return run(name, unit)


def family_of(name: Column) -> Column:
    """Family of the first word of the table that a name holds, else other."""
    low, out = F.lower(name), F.lit("other")
    for word, family in reversed(FAMILIES):
        out = F.when(F.contains(low, F.lit(word)), family).otherwise(out)
    return out


def qualifiers_in(name: Column) -> Column:
    low = F.lower(name)
    return F.filter(F.array(*(F.lit(q) for q in QUALIFIERS)), lambda q: F.contains(low, q))


def resolved(rows: DataFrame, name_col: str, dictionary: DataFrame) -> DataFrame:
    """rows with ``canonical``: the dictionary's name for theirs, unless it loses a qualifier that theirs has; else theirs in light form.

    dictionary: (key, canonical), key as by ``text.name_of``; a key has one row.
    """
    from seamlode.functions.text import light_name, name_of

    names = rows.select(F.col(name_col).alias("_name")).distinct().withColumn("_key", name_of(F.col("_name")))
    found = names.join(dictionary.select(F.col("key").alias("_key"), F.col("canonical").alias("_hit")), "_key", "left")
    lost = F.size(F.array_except(qualifiers_in(F.col("_name")), qualifiers_in(F.col("_hit")))) > 0
    found = found.select("_name", F.when(F.col("_hit").isNotNull() & ~lost, F.col("_hit")).otherwise(light_name(F.col("_name"))).alias("canonical"))
    return rows.join(found, rows[name_col].eqNullSafe(found["_name"]), "left").drop("_name")


def material_id(canonical: Column) -> Column:
    """Identifier of a material: formulas keep their case, other names are slugs."""
    from seamlode.functions import text

    formula = F.regexp_replace(F.left(F.regexp_replace(text.nfkc(canonical), "[^0-9A-Za-z]+", "-"), F.lit(48)), "^-+|-+$", "")
    return F.concat(F.lit("mat:"), F.when(text.is_formula_token(canonical) & (formula != ""), formula).otherwise(text.slug(canonical)))


def dictionary(concepts: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """(key, canonical, kind) of concepts(concept_id, canonical, kind, surface_forms, needs_review).

    Of several concepts of one form the shorter canonical name wins, then material before process, then the smaller name.
    """
    good = concepts.where(~F.coalesce("needs_review", F.lit(False)) & (F.trim(F.coalesce("canonical", F.lit(""))) != ""))
    if blocked:
        good = good.where(~F.col("concept_id").isin(blocked))
    forms = good.select(F.explode(F.concat(F.array("canonical"), F.coalesce("surface_forms", F.array()))).alias("form"), F.trim("canonical").alias("canonical"), "kind")
    keyed = forms.withColumn("key", F.lower(F.trim(F.regexp_replace("form", r"\s+", " ")))).where("key <> ''")
    rank = F.struct(F.length("canonical").alias("n"), (F.col("kind") != "material").alias("k"), F.col("canonical").alias("canonical"), F.col("kind").alias("kind"))
    return keyed.groupBy("key").agg(F.min(rank).alias("best")).select("key", "best.canonical", "best.kind")


def registered(raw: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``kind``, new registry rows): raw(name, unit_dim) by registry(name, aliases); unknown names become entries that need review."""
    known = registry.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), F.col("name").alias("kind"))
    known = known.groupBy(F.lower(F.trim("alias")).alias("key")).agg(F.min("kind").alias("kind"))
    rows = raw.withColumn("key", F.lower(F.trim("name"))).join(known, "key", "left")
    made = F.replace(F.replace("key", F.lit(" "), F.lit("_")), F.lit("%"), F.lit("pct"))
    new = rows.where("kind is null").groupBy(made.alias("name")).agg(F.min("unit_dim").alias("unit_dim"), F.array_sort(F.collect_set(F.col("name"))).alias("aliases"))
    return rows.withColumn("kind", F.coalesce("kind", made)).drop("key"), new.withColumn("status", F.lit("needs_review"))


def migrated(results: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, registry, report) once the kinds that need review are resolved by their names.

    results(quantity_kind, unit, conditions map), registry(name, unit_dim, aliases, status). Results of a junk name go; those of
    a resolved one move to its kind, with its subject among their conditions, and the name becomes an alias.
    """
    review = registry.where("status = 'needs_review'").join(results.groupBy(F.col("quantity_kind").alias("name")).agg(F.count("*").alias("n"), F.min("unit").alias("unit")), "name", "left")
    found = review.withColumn("c", quantity_of(F.col("name"), F.coalesce("unit", F.lit("")))).select("name", F.coalesce("n", F.lit(0)).alias("n_results"), "c.*")
    plan = found.withColumn("action", F.when(F.col("method") == "junk", "dropped").when(F.col("kind").isNull(), "left").when(F.col("kind") == F.col("name"), "confirmed").otherwise("moved"))
    step = plan.select(F.col("name").alias("quantity_kind"), "kind", "subject", "action")
    moved = results.join(F.broadcast(step), "quantity_kind", "left").where("action is null or action <> 'dropped'")  # as many rows as kinds under review
    taken = F.col("action") == "moved"
    with_subject = F.map_concat(F.map_filter(F.coalesce("conditions", F.create_map().cast("map<string,string>")), lambda k, _: k != "subject"), F.create_map(F.lit("subject"), "subject"))
    moved = moved.withColumn("conditions", F.when(taken & F.col("subject").isNotNull(), with_subject).otherwise(F.col("conditions")))
    moved = moved.withColumn("quantity_kind", F.when(taken, F.col("kind")).otherwise(F.col("quantity_kind"))).select(*results.columns)
    aliases = plan.where("action = 'moved'").groupBy(F.col("kind").alias("name")).agg(F.array_sort(F.collect_set("name")).alias("more"))
    kept = registry.join(plan.where("action in ('dropped', 'moved')").select("name"), "name", "left_anti").join(aliases, "name", "left")
    kept = kept.join(plan.where("action = 'confirmed'").select("name", F.lit(True).alias("sure")), "name", "left")
    empty = F.array().cast("array<string>")
    kept = kept.select("name", "unit_dim", F.array_union(F.coalesce("aliases", empty), F.coalesce("more", empty)).alias("aliases"), F.when(F.col("sure"), "confirmed").otherwise(F.col("status")).alias("status"))
    return moved, kept, plan


# -- conditions of experiments --------------------------------------------------------------

# Units of time as written -> hours.
HOURS = {"h": 1.0, "hr": 1.0, "hrs": 1.0, "hour": 1.0, "hours": 1.0, "min": 1 / 60, "minutes": 1 / 60, "d": 24.0, "day": 24.0, "days": 24.0}
_RATES = ("/", "min-1", "h-1", "per")


def tokens(sentence: str) -> list[str]:
    """Words, numbers, units and single signs."""
    return re.findall(r"\d+(?:[.,]\d+)*(?:-\d+(?:[.,]\d+)*)?|°\s?[CFK]?|[^\W\d_]+(?:-1)?|\S", sentence)


def _values_before(words: list[str], at: int) -> tuple[list[tuple[float, int]], int, bool]:
    """Numbers of a list or range that ends at a place, first to last, the place before them, and whether a dash joins them."""
    found, k, dash = [], at, False
    while k >= 0 and (words[k] in ("and", ",", "to", "-", "–", "or") or re.fullmatch(r"\d+(?:[.,]\d+)*", words[k])):
        if re.fullmatch(r"\d+(?:[.,]\d+)*", words[k]):
            found.append((float(words[k].replace(",", "")), k))
        else:
            dash |= words[k] in ("-", "–")
        k -= 1
    return found[::-1], k, dash


def _ranges(words: list[str], is_unit, alone: dict[str, tuple[float, str]]) -> list[tuple[float | None, float, list[float], str]]:
    """(lowest, highest, values, unit) of each number, list or range before a unit, and of words that stand for a value."""
    out = []
    for i, w in enumerate(words):
        if w in alone and (w != "room" or i == 0 or words[i - 1] != "from"):
            value, unit = alone[w]
            out.append((value, value, [value], unit))
        elif i and is_unit(words, i):
            both = re.fullmatch(r"(\d+(?:[.,]\d+)*)-(\d+(?:[.,]\d+)*)", words[i - 1])
            unit = "°C" if w.strip() == "°" else w.replace(" ", "")
            if both:
                a, b = sorted(float(x.replace(",", "")) for x in both.groups())
                out.append((a, b, [], unit))
                continue
            found, k, dash = _values_before(words, i - 1)
            if not found:
                continue
            values, before = [x for x, _ in found], words[k].lower() if k >= 0 else ""
            if len(values) == 2 and (dash or before in ("between", "from")):
                out.append((min(values), max(values), [], unit))
            elif len(values) == 1 and before == "up" or (len(values) == 1 and before == "to" and k and words[k - 1].lower() == "up"):
                out.append((None, values[0], values, unit))
            elif len(values) == 1 and k >= 0 and words[k] in ("−", "-"):
                out.append((-values[0], -values[0], [-values[0]], unit))
            else:
                up_to = len(values) == 1 and [x.lower() for x in words[max(0, found[0][1] - 2) : found[0][1]]] == ["up", "to"]
                out.append((None if up_to else min(values), max(values), values, unit))
    return out


def temperatures(sentence: str) -> list[tuple[float | None, float, list[float], str]]:
    """(lowest, highest, values, unit) of each temperature of a sentence; rates are none; room stands for 25 °C."""
    words = tokens(sentence)

    def unit(ws: list[str], i: int) -> bool:
        return bool(re.fullmatch(r"°\s?[CFK]?|K|C", ws[i])) and not any(r in "".join(ws[i + 1 : i + 4]) for r in _RATES)

    return _ranges(words, unit, {"room": (25.0, "°C")})


def durations(sentence: str) -> list[tuple[float | None, float, list[float], str]]:
    """(lowest, highest, values, unit) of each time of a sentence; overnight stands for 12 h."""
    return _ranges(tokens(sentence), lambda ws, i: ws[i] in HOURS, {"overnight": (12.0, "h")})


_RANGE = "array<struct<low:double,high:double,values:array<double>,unit:string>>"


def temperatures_of(sentence: Column) -> Column:
    return _listed(temperatures)(sentence)


def durations_of(sentence: Column) -> Column:
    return _listed(durations)(sentence)


def _listed(f):
    @F.pandas_udf(_RANGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else [{"low": a, "high": z, "values": v, "unit": u} for a, z, v, u in f(x)])

    return run


def duration_hours(text: Column) -> Column:
    """Hours of a single time: a number and its unit, or overnight; null for anything else."""
    from seamlode.functions.numeric import lookup

    value = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*([a-z]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*([a-z]+)", 2))
    return F.when(F.lower(text).contains("overnight"), 12.0).otherwise(value * lookup(HOURS, unit))
