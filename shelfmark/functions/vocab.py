"""Word lists, patterns, weights and limits that decide results.

Fixed values -- changing any of them changes query answers.
Larger rule tables (alias masters, taxonomy, product types) are inputs; small
defaults live in ``shelfmark.sources.defaults``.
"""

from __future__ import annotations

WHITESPACE = " \t\n\r\f\x0b"

# Values that mean "nothing was entered".
PLACEHOLDERS = (
    "-- unbranded --", "-- no unilog brand --", "-- no dib brand --",
    "-- no brand --", "-- no manufacturer --", "n/a", "na", "none", "unknown",
    "tbd", "not specified", "unspecified", "not available", "null",
    "-", "--", ".", "...", "???",
)

# The entity resolver accepts "..." and "???" as names.
RESOLVER_PLACEHOLDERS = PLACEHOLDERS[:17]

UNRESOLVED_WORDS = ("", "none", "unknown", "unclassified", "n/a", "not available", "null")

TEXT_STOP_VALUES = (
    "unclassified", "unknown", "none", "n/a", "na", "not available", "null", "-", "--", ".",
)
TEXT_STOP_WORD = r"(?i)\b(unclassified|unknown|none)\b"

EXPORT_BLANKS = ("none", "null", "n/a", "unclassified", "unknown", "")

COMPANY_SUFFIXES = (
    " inc", " inc.", " corp", " corp.", " corporation", " ltd", " ltd.", " limited",
    " llc", " llc.", " gmbh", " ag", " sa", " plc", " co", " co.", " group",
    " industries", " international",
)

HEDGES = (
    "approx", "maybe", "varies", "depends", "custom", "unknown", "n/a", "tbd",
    "unspecified", "see manual", "either", "or other",
)

TOKEN_ALIASES = {
    "milw": "Milwaukee", "milw.": "Milwaukee", "wh": "White", "bk": "Black",
    "blk": "Black", "lt": "Light", "elect": "Electric", "dg": "Dark Gray",
    "sst": "Stainless Steel", "bss": "Black Stainless Steel", "in.": "in",
}

UNIT_NAMES = {
    "in": "in", "in.": "in", "inch": "in", "inches": "in", '"': "in",
    "ft": "ft", "ft.": "ft", "foot": "ft", "feet": "ft", "'": "ft",
    "mm": "mm", "cm": "cm", "m": "m", "meter": "m", "meters": "m",
    "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb",
    "oz": "oz", "ounce": "oz", "ounces": "oz", "g": "g", "kg": "kg",
    "v": "V", "volts": "V", "volt": "V", "vac": "VAC", "vdc": "VDC", "kv": "kV",
    "a": "A", "amp": "A", "amps": "A", "amperes": "A", "ma": "mA",
    "w": "W", "watts": "W", "kw": "kW", "hz": "Hz", "hertz": "Hz",
    "psi": "psi", "bar": "bar", "deg": "deg", "c": "C", "f": "F",
}

# Attribute patterns searched in "<part number> <description>", in this order.
PHYSICAL_PATTERNS = (
    ("voltage", r"(?i)\b(\d+(?:\.\d+)?(?:\s*(?:-|–|—|/|to)\s*\d+(?:\.\d+)?)?\s*(?:V\s*AC|VAC|V\s*DC|VDC|Volts?|kV|V)\b(?:\s*(?:AC|DC))?)\b"),
    ("current", r"(?i)\b(\d+(?:\.\d+)?(?:\s*(?:-|–|—|/|to)\s*\d+(?:\.\d+)?)?\s*(?:Amps?|A|mA)\b)\b"),
    ("amperage", r"(?i)\b(\d+(?:\.\d+)?(?:\s*(?:-|–|—|/|to)\s*\d+(?:\.\d+)?)?\s*(?:Amps?|A|mA)\b)\b"),
    ("frequency", r"(?i)\b(\d+(?:/\d+)?\s*(?:Hz|hertz)\b)"),
    ("power", r"(?i)\b(\d+(?:\.\d+)?\s*(?:kW|kilowatts?|Watts?|W|HP|hp|horsepower)\b)"),
    ("pressure", r"(?i)\b(\d+(?:\.\d+)?\s*(?:psi|bar|Pa|kPa)\b)"),
    ("temperature", r"(?i)\b(-?\d+(?:\.\d+)?(?:\s*(?:to|-)\s*-?\d+(?:\.\d+)?)?\s*(?:°F|°C|deg\s*[FC]|F|C)\b)"),
    ("weight", r"(?i)\b(\d+(?:\.\d+)?\s*(?:lbs?|pounds?|kg|kilograms?|grams?|oz|ounces?))\b|\b(\d+(?:\.\d+)?\s+g)\b"),
    ("capacity", r"(?i)\b(\d+(?:\.\d+)?\s*(?:gal|gallons?|cu\.?\s*ft|cuft|liters?|litres?))\b|\b(\d+(?:\.\d+)?\s+l)\b"),
    ("rating", r"(?i)\b(\d+(?:\.\d+)?\s*(?:Watts?|W|HP|hp|Amps?|A)\b)"),
    ("poles", r"(?i)\b(\d+\s*(?:P|poles?)\b)"),
    ("grit", r"(?i)\b(P\d+|\d+\s*Grit|Grit\s*\d+|\b\d{2,4}\s*G\b)\b"),
)

MATERIALS = (
    (r"(?i)\b(stainless steel|sst)\b", "Stainless Steel"),
    (r"(?i)\b(black stainless steel|bss)\b", "Black Stainless Steel"),
    (r"(?i)\b(aluminum|aluminium)\b", "Aluminum"),
    (r"(?i)\b(pvc|vinyl)\b", "PVC"),
    (r"(?i)\b(composite)\b", "Composite"),
    (r"(?i)\b(steel)\b", "Steel"),
    (r"(?i)\b(copper)\b", "Copper"),
    (r"(?i)\b(brass)\b", "Brass"),
    (r"(?i)\b(zinc)\b", "Zinc"),
)

COLOURS_FINISHES = (
    (r"(?i)\b(black|bk|blk)\b", "Black", "color"),
    (r"(?i)\b(white|wh)\b", "White", "color"),
    (r"(?i)\b(nickel)\b", "Nickel", "finish"),
    (r"(?i)\b(chrome|chromium)\b", "Chrome", "finish"),
    (r"(?i)\b(brushed nickel)\b", "Brushed Nickel", "finish"),
    (r"(?i)\b(oil rubbed bronze|orb)\b", "Oil Rubbed Bronze", "finish"),
    (r"(?i)\b(polished brass)\b", "Polished Brass", "finish"),
    (r"(?i)\b(ss|stainless)\b", "Stainless", "finish"),
)

APPLICATIONS = (
    (r"(?i)\bgeneral purpose\b", "General Purpose"),
    (r"(?i)\bmetal cut off\b", "Metal Cutting"),
    (r"(?i)\bwood cutting\b", "Wood Cutting"),
    (r"(?i)\bindoor\b", "Indoor"),
    (r"(?i)\boutdoor\b", "Outdoor"),
)

CONNECTIONS = (
    (r"(?i)\b\d+\s*-\s*pole\b", "Pole Connection"),
    (r"(?i)\bd\.?ko\b", "DKO Arbor"),
    (r"(?i)\b\d+\s*mm\s*arbor\b", "Arbor Mount"),
)

MOUNT_PHRASE = r"(?i)\b((?:wall|ceiling|surface|panel)\s+mount)\b"

QUANTITIES = (
    r"(?i)\b(\d+)\s*(?:pc|pcs|pk|pack|piece|pieces)\b",
    r"(?i)\b(\d+)\s*disc\s*/\s*box\b",
    r"(?i)\b(\d+)\s*pack\b",
    r"(?i)\b(\d+)\s*box\b",
    r"(?i)\b(?:case|box)\s*of\s*(\d+)\b",
    r"(?i)\b(\d+)\s*case\b",
)
GRIT = r"(?i)\b(P\d+|\d+\s*Grit|Grit\s*\d+)\b"
SERIES = r"(?i)\b(?:series|ser\.?)\s*([A-Z0-9\-]+)\b"
MODEL = r"(?i)\b(?:model|mdl\.?)\s*#?\s*([A-Z0-9\-/]+)\b"

# Patterns tried, in order, when a value is looked up in an evidence text.
EVIDENCE_PATTERNS = {
    "voltage": (
        r"(?i)(\d+(?:\.\d+)?\s*(?:-|–|—|/|to)\s*\d+(?:\.\d+)?\s*(?:V|VAC|VDC|Volts?)\s*(?:AC|DC)?)",
        r"(?i)(\d+(?:\.\d+)?\s*(?:V\s*AC|VAC|V\s*DC|VDC|Volts?|V)\s*(?:AC|DC)?)",
        r"(?i)(\d+(?:\.\d+)?\s*(?:kV)\b)",
    ),
    "current": (
        r"(?i)(\d+(?:\.\d+)?)\s*(?:A|amp|amps|ampere|amperes)\b",
        r"(?i)(\d+(?:\.\d+)?)\s*(?:mA)\b",
    ),
    "frequency": (
        r"(?i)(\d+(?:/\d+)?)\s*(?:Hz|hertz)\b",
        r"(?i)(\d+)\s*-\s*(\d+)\s*(?:Hz|hertz)\b",
    ),
    "power": (
        r"(?i)(\d+(?:\.\d+)?)\s*(?:kW|KW|kilowatt|kilowatts)\b",
        r"(?i)(\d+(?:\.\d+)?)\s*(?:W|watt|watts)\b",
        r"(?i)(\d+(?:\.\d+)?)\s*(?:HP|hp|horsepower)\b",
    ),
    "dimensions": (
        r"(?i)(\d+(?:\.\d+)?)\s*[xX×]\s*(\d+(?:\.\d+)?)\s*[xX×]\s*(\d+(?:\.\d+)?)\s*(mm|cm|in|inch)?",
        r"(?i)(\d+(?:\.\d+)?)\s*mm\s*[xX×]\s*(\d+(?:\.\d+)?)\s*mm\s*[xX×]\s*(\d+(?:\.\d+)?)\s*mm",
    ),
    "weight": (
        r"(?i)(\d+(?:\.\d+)?)\s*(?:kg|kilogram|kilograms)\b",
        r"(?i)(\d+(?:\.\d+)?)\s*(?:g|gram|grams)\b",
        r"(?i)(\d+(?:\.\d+)?)\s*(?:lb|lbs|pound|pounds)\b",
    ),
    "poles": (
        r"(?i)(\d+)\s*(?:P|pole|poles)\b",
        r"(?i)(\d+)\s*-\s*pole",
    ),
    "trip_class": (r"(?i)(?:class|trip class)\s*(\d+)",),
    "mounting": (
        r"(?i)(DIN\s*rail\s*\d*\s*mm)",
        r"(?i)(panel\s*mount)",
        r"(?i)(wall\s*mount)",
        r"(?i)(surface\s*mount)",
    ),
    "temperature": (
        r"(?i)(-?\d+(?:\.\d+)?)\s*(?:°C|deg\s*C|celsius)",
        r"(?i)(-?\d+)\s*to\s*(-?\d+)\s*(?:°C|deg\s*C)",
    ),
    "protection": (r"(?i)(IP\s*\d{2}[A-Z]?)", r"(?i)(NEMA\s*\d+[A-Z]?)"),
    "efficiency": (r"(?i)(\d+(?:\.\d+)?)\s*%",),
    "input_voltage": (
        r"(?i)(\d+)\s*-\s*(\d+)\s*V\s*(?:AC|DC)?",
        r"(?i)(\d+(?:\.\d+)?)\s*(?:V|volt)\s*(?:AC|DC)?",
    ),
    "output_voltage": (r"(?i)(\d+(?:\.\d+)?)\s*(?:V|volt)\s*(?:AC|DC)?",),
    "output_current": (r"(?i)(\d+(?:\.\d+)?)\s*(?:A|amp)\b",),
}

# Retrieval questions asked for each attribute.
SPEC_QUERIES = {
    "voltage": ("voltage", "rated voltage", "operating voltage", "supply voltage"),
    "current": ("current", "rated current", "operating current", "amperage"),
    "frequency": ("frequency", "operating frequency", "hz"),
    "power": ("power", "rated power", "wattage", "kw"),
    "dimensions": ("dimensions", "size", "width", "height", "depth"),
    "weight": ("weight", "mass", "net weight"),
    "poles": ("poles", "number of poles", "phase"),
    "trip_class": ("trip class", "trip", "overload class"),
    "mounting": ("mounting", "mount type", "installation"),
    "temperature": ("temperature", "operating temperature", "ambient temperature"),
    "protection": ("protection", "ip rating", "ip class", "ingress protection"),
    "material": ("material", "housing material", "enclosure"),
    "certification": ("certification", "approval", "listed", "ul", "ce"),
    "efficiency": ("efficiency", "power factor"),
    "input_voltage": ("input voltage", "input", "primary voltage"),
    "output_voltage": ("output voltage", "output", "secondary voltage"),
    "output_current": ("output current", "output amperage"),
}

# Attributes that an evidence-only extraction must report on.
REPORTED_ATTRIBUTES = (
    "voltage", "current", "frequency", "dimensions", "material", "poles", "trip_class",
    "mounting", "application", "standards",
)

# Reliability of a source by the first word found in its document name.
SOURCE_WEIGHTS = (
    ("datasheet", 1.00), ("manufacturer", 1.00), ("spec", 0.98), ("catalog", 0.95),
    ("manual", 0.90), ("website", 0.80), ("distributor", 0.80), ("general", 0.75),
)
UNNAMED_SOURCE_WEIGHT = 0.85
NO_SOURCE_WEIGHT = 0.75

REQUIRED_ATTRIBUTES = ("voltage", "current")
NUMERIC_ATTRIBUTES = ("voltage", "current", "frequency", "poles", "power")
SEVERE_CONFLICT_ATTRIBUTES = ("voltage", "current", "poles")
GROUNDED_ATTRIBUTES = ("application", "standards", "material")

ALLOWED_UNITS = {
    "voltage": ("v", "kv", "mv", "vac", "vdc", "volts", "v ac", "v dc"),
    "current": ("a", "ma", "ka", "amps", "amperes", "amp"),
    "frequency": ("hz", "khz", "mhz", "hertz"),
    "dimensions": ("mm", "cm", "in", "inch", "inches", "m"),
    "power": ("kw", "w", "mw", "hp", "horsepower"),
    "poles": ("poles", "pole", "p", ""),
}

VALUE_BOUNDS = {
    "voltage": (0.1, 100000.0, "V"),
    "current": (0.001, 10000.0, "A"),
    "frequency": (10.0, 1000.0, "Hz"),
    "poles": (1, 12, "poles"),
}

CATEGORY_KEYWORDS = (
    ("abrasives", ("sanding belt", "cut-off disc", "cut off disc", "stikit", "abrasive", "disc/box", "hiolit", "abranet")),
    ("appliances", ("dishwasher", "refrigerator", "range", "oven", "washer", "dryer")),
    ("decking_building", ("decking", "deck board", "post trim", "composite", "pvc decking", "trex", "timbertech", "azek")),
    ("electrical", ("dimmer", "box cover", "switch", "outlet", "breaker", "conduit", "wire", "leviton")),
    ("lighting", ("wall light", "luminaire", "lamp", "fixture", "chandelier", "sconce", "led", "kichler", "lithonia")),
)

COARSE_CLASSES = (
    (("motor", "circuit breaker", "3rv"), "Motor Protection Circuit Breakers"),
    (("contactor", "lc1d"), "Contactors"),
    (("power supply", "quint"), "Industrial Power Supplies"),
)
COARSE_DEFAULT = "Industrial Automation"

KEY_SPECS = (
    "dimensions", "size", "grit", "voltage", "current", "power", "weight", "poles",
    "material", "finish", "color", "quantity",
)
SPEC_FALLBACK_SKIP = (
    "dept", "class", "fine", "classpath", "product_type", "candidate_type",
    "candidate_brand", "source_brand",
)
LONG_TEXT_SKIP = (
    "dept", "class", "fine", "classpath", "product_type", "candidate_type", "source_brand",
)

DESCRIPTION_LIMITS = {
    "short": 120, "long": 1000, "invoice": 60, "mobile": 80, "retail": 500, "marketing": 800,
}

REVIEW_ACTIONS = ("ACCEPT_AI_VALUE", "SELECT_ALTERNATIVE", "MARK_UNKNOWN", "DISMISS_CONFLICT")

STAGES = (
    "01 IDENTIFY", "02 DISCOVER", "03 EXTRACT", "04 NORMALIZE",
    "05 VALIDATE", "06 DECIDE", "07 REVIEW", "08 PUBLISH",
)

DOCUMENT_EXTENSIONS = ("pdf", "png", "jpg", "jpeg")
MAX_FILE_BYTES = 50 * 1024 * 1024
CHUNK_MAX_CHARS = 2000
CHUNK_MIN_CHARS = 10

HEADER_ALIASES = {
    "part_number": ("Mfg_Part_Num", "part_number", "MPN"),
    "brand": ("Brand", "brand", "Manufacturer"),
    "description": ("Part_Desc", "description", "Description"),
    "category": ("Category", "category"),
    "manufacturer": ("Part_Manuf", "manufacturer"),
}


def delivery_columns() -> tuple[str, ...]:
    """The 252 export columns in file order, numbered groups built by rule."""
    head = ["MFR URL"] + [f"Ref URL {i}" for i in range(1, 6)]
    head += ["PART_NUMBER", "Dept", "Class", "Fine", "SKU - MY_PART_NUMBER", "Mfg_Part_Num",
             "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf",
             "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME", "MANUFACTURER_PART_NUMBER",
             "ALTERNATE_PART_NUMBER", "Classpath", "MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC",
             "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION"]
    features = [f"ITEM_FEATURES_{i}" for i in range(1, 21)]
    misc = ["With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name"]
    triplets = [f"ATTRIBUTE_{part} {i}" for i in range(1, 51) for part in ("LABEL", "VALUE", "UOM")]
    codes = ["UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty",
             "Selling UOM", "Standard Packaging Information"]
    measures = [c for m in ("LENGTH", "HEIGHT", "WIDTH", "WEIGHT", "VOLUME") for c in (m, f"{m}_UOM")]
    assets = ["Product Image"] + [f"Alternate Image {i}" for i in range(1, 5)]
    assets += ["SDS", "SDS_1", "Warranty Information", "Catalog", "Specification Sheet",
               "Instruction/Installation Manual", "Service Manual", "Owners/User Manual",
               "Line Drawing", "MTR", "RoHS", "Full Engineering Drawing", "Energy Star Guide",
               "Technical Bulletin", "Submittal", "Compatibility Chart", "Size Chart",
               "Product Label/Insert", "Video Link", "Video Link 1", "Country Of Origin",
               "Discontinued", "Actual Image (Yes/No)"]
    return tuple(head + features + misc + triplets + codes + measures + assets)
