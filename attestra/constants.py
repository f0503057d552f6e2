"""Word lists, tables, thresholds and patterns that results depend on."""

# --- Evidence -------------------------------------------------------------------------
LITERATURE_KINDS = ["target", "publication", "trial", "patent", "dataset", "disease", "drug", "figure"]
CURATED_KINDS = ["target", "disease", "drug", "trial", "patent", "dataset"]
REFERENCE_LABELS = [  # (prefix of the base id, title shown for that source)
    ("PMCID:", "PubMed Central full text"),
    ("ENSG", "Open Targets - target record"),
    ("UNIPROT:", "UniProt - protein entry"),
    ("PATENT:", "EPO Espacenet - patent record"),
]

# --- Claims ---------------------------------------------------------------------------
CARD_SOURCES = ["Open Targets", "UniProt"]
CARD_ROUTES = [  # (id suffix, section that owns the question)
    ("#localization", "target_biology"),
    ("#domains", "target_biology"),
    ("#expression", "disease_indications"),
    ("#tractability", "modality_developability"),
    ("#safety", "modality_developability"),
]
CARD_CONFIDENCE = 0.9
CLAIM_OVERLAP = 0.5
GRADE_LEVELS = ["very_low", "low", "moderate", "high"]
GRADE_BASE = {
    "randomized_controlled": 3,
    "single_arm": 2,
    "observational": 1,
    "post_hoc": 1,
    "preclinical_nhp": 0,
    "in_vitro": 0,
}
SMALL_SAMPLE = 50
MIN_SUPPORTED = 2
SEVERITY_RANK = {"manageable": 1, "significant": 2, "severe": 3}

# --- Retrieval ------------------------------------------------------------------------
RRF_K = 60
CANDIDATES = 50
TOP_K = 8
VARIANTS = 4

# --- Expert ranking -------------------------------------------------------------------
FULLTEXT_WEIGHT = 3
ABSTRACT_WEIGHT = 1
LABS_KEPT = 3

# --- Frozen-table analysis ------------------------------------------------------------
ANALYSIS_TEMPLATE = "trop2_analysis"
ANALYSIS_VERSION = "1.0.0"
DEPENDENCY_CUTOFF = -0.5
LINEAGE_MIN_N = 5
TUMOR_SAMPLE_TYPES = ["Primary Solid Tumor", "Recurrent Solid Tumor", "Metastatic"]
NORMAL_SAMPLE_TYPES = ["Solid Tissue Normal"]
SAMPLE_CLASSES = ["tumor", "normal"]
COHORT_STUDY = "brca_tcga_pan_can_atlas_2018"
COHORT_PROFILE = "brca_tcga_pan_can_atlas_2018_rna_seq_v2_mrna"
RESULT_KEY_PATTERN = r"^[a-z][a-z0-9_.-]*\z"

# USD per million tokens (in, out); a model outside this table has no known price.
PRICES = [
    ("openai/gpt-oss-120b", 0.15, 0.75),
    ("llama-3.3-70b-versatile", 0.59, 0.79),
    ("claude-sonnet-4-5", 3.0, 15.0),
    ("claude-sonnet-4-6", 3.0, 15.0),
    ("claude-haiku-4-5", 1.0, 5.0),
]
FREE_MODEL_PREFIXES = ["ollama/", "local/"]

# --- Patents and sequences ------------------------------------------------------------
LEGAL_CODES = [  # (code, category, effect); every other code is neutral
    ("PG25", "granted", "active"),
    ("FG4D", "granted", "active"),
    ("MM4A", "lapsed-nonpayment", "inactive"),
    ("PLFP", "fee-paid", "active"),
    ("PLBE", "lapsed", "inactive"),
    ("MK9A", "expired", "inactive"),
    ("WD", "withdrawn", "inactive"),
]
REGION_RANGES = [  # (region, first position, last position)
    ("FR1", 1, 26),
    ("CDR1", 27, 38),
    ("FR2", 39, 55),
    ("CDR2", 56, 65),
    ("FR3", 66, 104),
    ("CDR3", 105, 117),
    ("FR4", 118, 128),
]
CONSTANT_LABELS = ["Fc", "CH1", "CL", "hinge", "heavy-chain", "light-chain", "Fab"]
VALID_RESIDUES = "ACDEFGHIKLMNPQRSTVWYUN"
MIN_RESIDUES = 4
MIN_ALIGN_LENGTH = 50
COMPETITOR_IDENTITY = 98.0
LOOP_IDENTITY = 90.0
MIN_READABLE_CHARS = 50

PATENT_CANDIDATE = "(?U)[A-Z]{2}[ \u00a0]?[0-9][0-9,.\\s/]{2,}[0-9](?:[ \u00a0]?[A-Z][0-9]?)?"
PATENT_NUMBER = r"^([A-Z]{2})(\d+)([A-Z]\d?)?\z"
CLAIMS_HEADING = r"(?im)^\s*#*\s*claims\s*$"
LISTING_BLOCK = (
    r"SEQ\s*ID\s*NO[:.\s]*?(\d+)\s*[:.)\-]?\s*\n?([A-Z][A-Z0-9\s]*?)(?=SEQ\s*ID\s*NO|\n\s*\n|\z)"
)
DECLARED_LENGTH = r"<210>\s*(\d+)(?:(?!<210>)[\s\S]){0,80}?<211>\s*(\d+)"
XML_LISTING = r"<ST26SequenceListing|<INSDSeq_sequence>"
HUMAN_SPECIES = "(?i)homo|human"
OTHER_SPECIES = "(?i)mus|mouse|rat|rabbit|rhesus|macaca"

# Words of a feature note that name a chain, a loop number, a loop's chain or a region.
HEAVY_CHAIN = r"heavy|\bhc\b|\bvh\b|hcdr|\bh[- ]?cdr|\bfr[- ]?h"
LIGHT_CHAIN = r"light|\blc\b|\bvl\b|lcdr|\bl[- ]?cdr|\bfr[- ]?l|kappa|lambda"
LOOP_NUMBERS = [r"cdr[- ]?[hl]?[- ]?([123])\b", r"[hl]cdr[- ]?([123])\b", r"cdr\D*?([123])\b"]
LOOP_CHAINS = [r"([hl])[- ]?cdr", r"cdr[- ]?([hl])(?=\d|\W|\z)"]
VARIABLE_DOMAIN = r"variable|\bvh\b|\bvl\b|\bfv\b"
OTHER_REGIONS = [
    (r"\bfab\b", "Fab"),
    (r"\bfc\b", "Fc"),
    (r"\bch1\b", "CH1"),
    (r"\bcl\b|constant light", "CL"),
    (r"hinge", "hinge"),
]

# --- Figures --------------------------------------------------------------------------
FIGURE_TYPES = ["forest_plot", "kaplan_meier", "dose_response", "bar", "flow", "other"]

# --- Quality --------------------------------------------------------------------------
PASS_MARKS = {
    "grounding_integrity": 0.99,
    "computation_grounding": 1.0,
    "retrieval_recall": 0.6,
    "developability_catch": 0.5,
    "figure_grounding": 0.5,
    "faithfulness": 0.9,
    "claim_probes": 0.8,
}
MAX_FLIP_RATE = 0.2
MAX_UNSUPPORTED = 0.1
FIGURE_GATE_N = 3
REGRESSION_TOLERANCE = [
    ("grounding_integrity", 0.0),
    ("computation_grounding", 0.0),
    ("faithfulness", 0.03),
    ("retrieval_recall", 0.05),
    ("unsupported_sentence_ratio", 0.05),
    ("verdict_stability", 0.1),
    ("kol_precision_at_k", 0.1),
    ("developability_catch", 0.1),
    ("claim_probes", 0.1),
    ("figure_grounding", 0.1),
]
ABSOLUTE_FLOORS = [("figure_grounding", 0.5), ("computation_grounding", 1.0)]
MUST_PASS = ["grounding_integrity", "computation_grounding"]

# Reasons a claim bound to a computation is dropped for.
DROP_REASONS = {
    "unbound": "claim cites computation evidence without a structured binding",
    "no_evidence": "missing valid computation evidence",
    "not_cited": "claim does not cite its computation evidence",
    "no_key": "result key is absent from computation evidence",
    "failed": "computation did not exit successfully",
    "invalid": "primary results failed schema, identity, or hash validation",
    "no_value": "bound result is missing or null",
    "unit": "asserted unit does not match typed result",
    "value": "asserted value does not match typed result",
    "replay_invalid": "replay results failed schema validation",
    "replay_contract": "replay run contract does not match the primary run",
    "replay_value": "replay output mismatched beyond the declared tolerance",
    "origin": "cached computation lacks verified signed origin",
}
