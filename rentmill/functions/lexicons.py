"""Word lists and markers that the judged results depend on. Order matters: the first hit counts."""

# Prices.
PERIOD_WORDS = (
    ("month", ("mois", "mensuel", "mensuelle", "monthly", "/mo", "par mois", "month")),
    ("week", ("semaine", "hebdomadaire", "weekly", "/wk", "week")),
    ("day", ("nuit", "nuitee", "jour", "nightly", "daily", "par nuit", "night")),
)
ON_REQUEST = (
    "prix sur demande", "sur demande", "a discuter", "a negocier", "please contact", "contact for price", "nous contacter",
)

# Places.
POSTAL_PROVINCES = (("G", "QC"), ("H", "QC"), ("J", "QC"), ("K", "ON"), ("L", "ON"), ("M", "ON"), ("N", "ON"), ("P", "ON"))
OUTAOUAIS_CITIES = (
    "gatineau", "hull", "aylmer", "buckingham", "masson-angers", "masson angers", "chelsea", "cantley", "val-des-monts",
    "val des monts", "la peche", "wakefield", "pontiac", "luskville", "quyon", "thurso", "l'ange-gardien", "ange-gardien",
    "notre-dame-de-la-salette", "denholm", "low", "lac-sainte-marie", "gracefield", "bowman", "mayo", "plaisance",
    "papineauville", "montebello", "fassett", "saint-andre-avellin", "cheneville", "namur", "duhamel", "ripon",
    "val-des-bois", "mulgrave-et-derry", "lochaber", "maniwaki", "outaouais",
)
ONTARIO_CITIES = (
    "ottawa", "nepean", "kanata", "orleans", "barrhaven", "gloucester", "vanier", "stittsville", "rockland",
    "clarence-rockland", "embrun", "casselman", "russell", "limoges", "arnprior", "carleton place", "almonte", "renfrew",
    "pembroke", "cornwall", "hawkesbury", "manotick", "greely", "osgoode", "metcalfe", "richmond", "munster",
    "constance bay", "dunrobin", "carp", "navan", "cumberland", "sarsfield", "bourget", "alfred", "plantagenet",
    "wendover", "westboro", "hintonburg", "centretown", "sandy hill", "byward", "alta vista", "riverside south",
    "findlay creek", "blackburn hamlet", "gatineau hills",
)
QUEBEC_TOKENS = (", qc", " qc ", "(qc)", "quebec", ", qu ", "province de quebec")
ONTARIO_TOKENS = (", on", " on ", "(on)", "ontario", ", ont")
EARTH_RADIUS_KM = 6371.0088

# Appliances.
APPLIANCE_TERMS = (
    ("washer", ("laveuse", "lave-linge", "washing machine", "washer")),
    ("dryer", ("secheuse", "seche-linge", "dryer")),
    ("fridge", ("refrigerateur", "frigidaire", "frigo", "fridge", "refrigerator")),
    ("stove", ("cuisiniere", "poele", "stove", "oven")),
    ("dishwasher", ("lave-vaisselle", "lave vaisselle", "dishwasher")),
)
KITCHEN_BUNDLE = (
    "electromenagers inclus", "electromenagers fournis", "electros inclus", "electro inclus", "electromenager",
    "appliances included", "all appliances", "appliances provided",
)
HOOKUP_MARKERS = (
    "espace pour", "espace laveuse", "espace buanderie", "branchement", "raccordement", "prise pour", "emplacement pour",
    "prevu pour", "pret pour", "hookup", "hook-up", "hook up", "rough-in", "ready for", "space for",
)
SHARED_MARKERS = (
    "commune", "commun", "partagee", "partage", "shared", "coin laundry", "laverie", "dans l'immeuble", "de l'immeuble",
    "in the building", "buanderie au sous-sol",
)
NEGATED_BEFORE = ("sans", "pas de", "pas d'", "aucun", "aucune", "ni ", "no ", "not ", "without")
NEGATED_AFTER = (
    "non inclus", "non incluse", "non fourni", "pas inclus", "pas incluse", "not included", "not provided", "excluded",
)
CLAUSE_ENDS = ".;!?\n|•·"

# Dwellings.
ROOM_PHRASES = (
    "chambre a louer", "chambres a louer", "chambre a sous-louer", "chambre disponible", "chambres disponibles",
    "chambre dans", "chambre meublee dans", "chambre pour", "maison de chambres", "colocation", "colocataire",
    "coloc recherche", "recherche coloc", "room for rent", "rooms for rent", "room to rent", "room available",
    "room rental", "rooming house", "roommate", "room mate", "shared house", "shared apartment",
    "shared accommodation", "shared living", "logement partage", "appartement partage",
)
UNIT_PHRASES = (
    "appartement", "logement", "condo", "studio", "loft", "bachelor", "duplex", "triplex", "quadruplex",
    "maison de ville", "townhouse", "jumele", "bungalow", "apartment", "unit entier", "entire unit", "whole unit",
)
UNIT_TYPES = (
    ("studio", ("studio", "bachelor")),
    ("loft", ("loft",)),
    ("condo", ("condo",)),
    ("house", ("maison", "bungalow", "house", "cottage")),
    ("townhouse", ("maison de ville", "townhouse", "jumele")),
    ("duplex", ("duplex", "triplex", "quadruplex")),
    ("basement", ("sous-sol", "basement", "demi sous-sol")),
    ("apartment", ("appartement", "logement", "apartment", "flat")),
)

# Characters that are folded together.
APOSTROPHES = "‘’ʼ´`"
DASHES = "‐‑‒–—―−"
FRACTION_SLASH = "⁄"
