"""Check a configuration before anything runs."""

from __future__ import annotations

from maskflow.operators.generators import GENERATORS
from maskflow.operators.masks import MASKS

# Settings that name another column of the table.
FIELD_SETTINGS = [
    "gender_field", "first_name_field", "last_name_field", "plz_field", "plz", "location_field", "location_data_col",
    "canton_field", "streetname_field",
]
REQUIRED_BY_MASKS = {
    "formatted_numbers": ["replace_last_digits"],
    "hash": ["hashed_columns"],
    "list_string": ["list"],
    "blur_address": ["location_code_col", "location_data_col"],
}
REQUIRED_BY_GENERATORS = {
    "list_string": ["list"],
    "random_float": ["min", "max"],
    "normal_float": ["mean", "std"],
    "normal_int": ["mean", "std"],
    "integer_grouped": ["values"],
}


def check_config(config: dict, table_columns: list[str] | None = None) -> list[str]:
    """What is wrong, in words; an empty list if nothing is.

    With `table_columns` the configuration is for masking that table, else for generating a new one.
    """
    masks = table_columns is not None
    known = set(MASKS) | {"delete"} if masks else set(GENERATORS)
    required = REQUIRED_BY_MASKS if masks else REQUIRED_BY_GENERATORS
    problems: list[str] = []
    columns = config.get("columns")
    if not isinstance(columns, dict):
        return ["the configuration has no columns"]
    there = list(table_columns or [])
    for name, settings in columns.items():
        function = settings.get("function")
        if masks and name not in there:
            problems.append(f"{name}: not a column of the table")
        if function and function not in known:
            problems.append(f"{name}: {function!r} is not a known function")
        problems += [f"{name}: {function} needs {p!r}" for p in required.get(function, []) if p not in settings]
        if function == "list_int" and not {"list", "values"} & set(settings):
            problems.append(f"{name}: list_int needs 'list' or 'values'")
        named = [settings[f] for f in FIELD_SETTINGS if isinstance(settings.get(f), str)]
        named += settings.get("hashed_columns", [])
        problems += [f"{name}: there is no column {c!r} to read" for c in named if c not in there and not c.startswith("<")]
        weights = settings.get("weights")
        if weights is not None and "list" in settings and len(weights) != len(settings["list"]):
            problems.append(f"{name}: weights and list differ in length")
        if not masks:
            # A generator reads columns made before it.
            there += settings.get("labels", []) if function == "address" else [name]
    return problems
