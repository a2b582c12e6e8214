"""Rule tables: word lists, patterns and templates, as data. All are fixed values that results depend on."""

from __future__ import annotations

#: Word edges that mean the same in every regular-expression dialect used here.
EDGE_LEFT = r"(?:^|[^\p{L}\p{N}_])"
EDGE_RIGHT = r"(?:$|[^\p{L}\p{N}_])"
#: The same without taking a character; Java only.
BEFORE_WORD = r"(?<![\p{L}\p{N}_])"
AFTER_WORD = r"(?![\p{L}\p{N}_])"


def word(pattern: str) -> str:
    """A pattern that must stand between word edges."""
    return EDGE_LEFT + "(?:" + pattern + ")" + EDGE_RIGHT


# Blocks

HEADING_PATTERNS = (r"^chapter\s+\d+", r"^section\s+\d+", r"^\d+\.\d+", r"^[a-z]\)", r"^\(\d+\)")
BULLETS = ("•", "-", "*", "–")
NUMBERED_ITEM = r"^\d+\.?\s"
CAPTION = r"^(figure|fig\.?|table|tab\.?)\s*\d+"
FORMULA_MARKS = ("=", "∫", "∑", "∏", "∂", "∇", "lim", "→")
FORMULA_BLOCK_CHARS = 200

# Chunks: type, domain, difficulty

CONTENT_TYPES = (
    ("definition", word(r"def(?:ine|inition)")),
    ("theorem", word("theorem|lemma|corollary")),
    ("proof", word("proof")),
    ("example", word("example")),
    ("exercise", word("exercise|problem")),
)
CHUNK_TYPES = (
    ("definition", word(r"defin(?:e|ition|ed)|is\s+called|we\s+define|denote")),
    ("theorem", word("theorem|lemma|corollary|proposition")),
    ("proof", word(r"proof|prove|qed|we\s+show\s+that") + r"|[\p{L}\p{N}_]∎[\p{L}\p{N}_]"),
    ("example", word(r"example|consider|suppose|let\s+us")),
    ("exercise", word(r"exercise|problem|question|find|calculate|show\s+that")),
)
CHUNK_FORMULA_MARKS = ("=", "∫", "∑", "∂", "∇", "→")

DOMAIN_KEYWORDS = {
    "physics": ("force", "mass", "acceleration", "velocity", "momentum", "energy", "work", "power", "wave", "field", "potential", "electric", "magnetic", "quantum", "relativity", "particle", "thermodynamics", "entropy", "optics", "mechanics"),
    "mathematics": ("theorem", "proof", "lemma", "corollary", "axiom", "function", "derivative", "integral", "limit", "series", "matrix", "vector", "topology", "algebra", "geometry", "calculus", "equation", "polynomial", "differential"),
    "chemistry": ("molecule", "atom", "bond", "reaction", "compound", "element", "orbital", "electron", "ion", "acid", "base", "oxidation", "reduction", "equilibrium", "solution", "concentration", "mole", "catalyst", "polymer"),
    "data_science": ("model", "algorithm", "dataset", "feature", "prediction", "regression", "classification", "clustering", "neural", "training", "validation", "accuracy", "precision", "recall", "optimization", "gradient", "loss", "batch", "epoch"),
    "statistics": ("probability", "distribution", "variance", "deviation", "mean", "median", "mode", "hypothesis", "confidence", "correlation", "regression", "sample", "population", "significance", "bayesian", "likelihood", "estimation"),
}
DIFFICULTY_WORDS = {
    "introductory": ("basic", "introduction", "fundamental", "simple", "beginner", "elementary", "first", "overview"),
    "intermediate": ("application", "example", "practice", "typical", "standard", "common", "general"),
    "advanced": ("advanced", "complex", "rigorous", "theoretical", "proof", "derivation", "generalization", "abstract"),
}
PROOF_MARKS = r"\\begin\{proof\}|∎|qed"
CONCEPT_SCIENTISTS = ("Newton", "Maxwell", "Einstein", "Schrödinger", "Heisenberg", "Boltzmann", "Planck", "Faraday", "Gauss", "Coulomb")
#: Over lower-case text. Phrases have at most 61 words, here and below, so that no text exhausts the pattern matcher's stack.
LAW_WORDS = ("law", "theorem", "equation", "principle", "rule", "formula", "constant")
NAMED_LAW = EDGE_LEFT + r"([a-z][a-z]+(?:\s+[a-z][a-z]+){0,60}(?:'s)?)\s+(?:" + "|".join(LAW_WORDS) + ")"
CAPITALISED = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,60})"
ABSTRACT_NOUN = r"([a-z]+(?:tion|ment|ness|ity))"
CHUNK_STOPWORDS = ("the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had")

# Keyword index

INDEX_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to",
    "for", "of", "with", "by", "from", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must",
    "that", "which", "who", "whom", "this", "these", "those",
    "it", "its", "as", "if", "when", "than", "so", "no", "not",
)

# Queries

QUERY_FORMULA_MARKS = ("=", "\\", "^", "_", "∫", "∑", "∂", "∇", "→", "≈", "≠")
DIAGRAM_WORDS = ("diagram", "graph", "plot", "figure", "image", "picture")
INTENTS = (
    ("definition", (r"what\s+is\s+(?:a|an|the)?\s*", r"define\s+", r"definition\s+of\s+", r"meaning\s+of\s+")),
    ("explanation", (r"explain\s+", r"how\s+does\s+", r"why\s+does\s+", r"describe\s+")),
    ("derivation", (r"derive\s+", r"derivation\s+of\s+", r"how\s+(?:to|do\s+you)\s+derive\s+", r"show\s+(?:the\s+)?derivation")),
    ("example", (r"example\s+of\s+", r"give\s+(?:me\s+)?(?:an?\s+)?example", r"show\s+(?:me\s+)?(?:an?\s+)?example", r"for\s+example")),
    ("formula_lookup", (r"formula\s+for\s+", r"equation\s+for\s+", r"what\s+(?:is\s+)?the\s+formula", r"find\s+(?:the\s+)?formula")),
    ("proof", (r"prove\s+", r"proof\s+of\s+", r"show\s+that\s+", r"demonstrate\s+")),
    ("comparison", (r"compare\s+", r"difference\s+between\s+", r"how\s+(?:does|do)\s+.*\s+differ\s+from", r"vs\.?\s+")),
    ("application", (r"application\s+of\s+", r"how\s+(?:to|do\s+I)\s+use\s+", r"when\s+(?:to|do\s+I)\s+use\s+", r"apply\s+")),
    ("visualization", (r"show\s+(?:me\s+)?(?:the\s+)?diagram", r"visualize\s+", r"graph\s+of\s+", r"plot\s+", r"draw\s+")),
    ("calculation", (r"calculate\s+", r"compute\s+", r"find\s+(?:the\s+)?value", r"solve\s+", r"evaluate\s+")),
)
QUERY_DOMAINS = {
    "physics": ("force", "energy", "momentum", "velocity", "acceleration", "mass", "field", "wave", "quantum", "relativity", "electric", "magnetic", "thermodynamics", "mechanics", "optics"),
    "mathematics": ("function", "derivative", "integral", "limit", "series", "matrix", "vector", "theorem", "proof", "equation", "calculus", "algebra", "geometry", "topology"),
    "chemistry": ("molecule", "atom", "bond", "reaction", "compound", "element", "electron", "orbital", "acid", "base", "oxidation", "equilibrium", "concentration"),
    "data_science": ("model", "algorithm", "dataset", "training", "prediction", "regression", "classification", "neural", "learning", "feature", "accuracy", "loss", "optimization"),
    "statistics": ("probability", "distribution", "variance", "mean", "hypothesis", "confidence", "correlation", "sample", "significance", "bayesian", "regression"),
}
QUERY_STOPWORDS = (
    "what", "is", "the", "a", "an", "how", "why", "when", "where",
    "which", "who", "does", "do", "can", "could", "would", "should",
    "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "this", "that", "these", "those", "it", "its", "of", "for", "to",
    "in", "on", "at", "by", "with", "from", "about", "into", "between",
)
QUERY_FORMULAS = (r"(?s)\$\$(.+?)\$\$", r"\$([^$]+?)\$", r"(?s)\\begin\{equation\}(.+?)\\end\{equation\}", r"(?s)\\\[(.+?)\\\]", r"(?s)\\\((.+?)\\\)", r"([A-Za-z]+\s*=\s*[^,\.\s]+)")
ENTITY_SCIENTISTS = ("Newton", "Einstein", "Maxwell", "Schrödinger", "Heisenberg", "Planck", "Boltzmann", "Gauss", "Euler", "Leibniz")
EXPANSIONS = {
    "derivative": ("differentiation", "d/dx", "rate of change"),
    "integral": ("integration", "antiderivative", "area under curve"),
    "momentum": ("p", "mv", "linear momentum"),
    "energy": ("E", "kinetic", "potential", "work"),
    "force": ("F", "newton", "N", "push", "pull"),
    "velocity": ("v", "speed", "rate"),
    "acceleration": ("a", "deceleration"),
}

# Formulas

OPERATORS = (
    ("derivative", r"\\frac\{d"),
    ("partial", r"\\partial"),
    ("integral", r"\\int"),
    ("sum", r"\\sum"),
    ("product", r"\\prod"),
    ("limit", r"\\lim"),
    ("gradient", r"\\nabla"),
    ("divergence", r"\\nabla\s*\\cdot"),
    ("curl", r"\\nabla\s*\\times"),
    ("laplacian", r"\\nabla\^2|\\Delta"),
    ("cross_product", r"\\times"),
    ("dot_product", r"\\cdot"),
    ("factorial", r"!"),
)
FUNCTIONS = (
    r"\\(sin|cos|tan|cot|sec|csc)",
    r"\\(sinh|cosh|tanh|coth)",
    r"\\(arcsin|arccos|arctan)",
    r"\\(log|ln|exp)",
    r"\\(sqrt|cbrt)",
    r"\\(det|tr|rank)",
    r"\\(min|max|sup|inf)",
    r"\\(gcd|lcm)",
    r"([A-Z][a-z]*)\s*\(",
)
VARIABLE = r"(?<![\\a-zA-Z])([a-zA-Z](?:_\{?[a-zA-Z0-9]+\}?)?)"
CONSTANTS = (
    ("pi", r"\\pi"),
    ("e", r"\\mathrm\{e\}|(?<![a-zA-Z])e(?![a-zA-Z])"),
    ("i", r"\\mathrm\{i\}"),
    ("hbar", r"\\hbar"),
    ("planck", r"h(?![a-zA-Z])"),
    ("c", r"c(?![a-zA-Z])"),
    ("G", r"G(?![a-zA-Z])"),
    ("epsilon_0", r"\\epsilon_0|\\varepsilon_0"),
    ("mu_0", r"\\mu_0"),
    ("k_B", r"k_B"),
    ("N_A", r"N_A"),
    ("R", r"R(?![a-zA-Z])"),
    ("alpha", r"\\alpha"),
    ("infinity", r"\\infty"),
)
#: Pattern that must be found, pattern that must not be.
FORMULA_TYPES = (
    ("integral", r"\\int|\\iint|\\iiint|\\oint", None),
    ("derivative", r"\\frac\{d|\\frac\{\\partial", None),
    ("limit", r"\\lim", None),
    ("summation", r"\\sum", None),
    ("product", r"\\prod", None),
    ("matrix", r"\\begin\{matrix\}|\\begin\{pmatrix\}|\\begin\{bmatrix\}", None),
    ("chemical", r"\\ce\{|->|\\rightarrow.*\\ce", None),
    ("equation", r"=", r"\\neq|\\leq|\\geq|<|>"),
    ("inequality", r"\\leq|\\geq|<|>|\\neq", None),
)
#: A kind that formula records do not know and store as unknown.
UNSTORED_FORMULA_TYPE = "product"
FORMULA_DOMAINS = (
    ("chemistry", ("\\ce{", "\\rightarrow", "mol", "pH", "K_a", "K_b", "K_p", "\\Delta H", "\\Delta G", "\\Delta S", "R", "T")),
    ("physics", ("\\vec", "\\nabla", "\\partial t", "F", "m", "a", "v", "E", "p", "\\hbar", "c", "G", "k_B", "\\epsilon_0", "\\mu_0", "\\psi", "\\phi", "\\Phi", "\\omega", "H", "L")),
    ("statistics", ("P(", "\\mathbb{E}", "\\sigma", "\\mu", "Var", "Cov", "\\hat", "\\bar", "n!", "\\binom")),
    ("mathematics", ("\\lim", "\\sum", "\\prod", "\\int", "dx", "dy", "\\infty", "\\forall", "\\exists", "\\in", "\\subset")),
)
#: Pattern and replacement, in order; ``<1>`` and ``<2>`` stand for groups.
PLAIN_TEXT = (
    (r"\\frac\{([^}]+)\}\{([^}]+)\}", "<1> divided by <2>"),
    (r"\\sqrt\{([^}]+)\}", "square root of <1>"),
    (r"\\sum", "sum of"),
    (r"\\int", "integral of"),
    (r"\\partial", "partial"),
    (r"\\nabla", "gradient"),
    (r"\\cdot", "dot"),
    (r"\\times", "cross"),
    (r"\^2", " squared"),
    (r"\^3", " cubed"),
    (r"\^", " to the power of "),
    (r"_", " subscript "),
    (r"\\alpha", "alpha"),
    (r"\\beta", "beta"),
    (r"\\gamma", "gamma"),
    (r"\\delta", "delta"),
    (r"\\epsilon", "epsilon"),
    (r"\\theta", "theta"),
    (r"\\lambda", "lambda"),
    (r"\\mu", "mu"),
    (r"\\pi", "pi"),
    (r"\\sigma", "sigma"),
    (r"\\omega", "omega"),
    (r"\\infty", "infinity"),
    (r"\\pm", "plus or minus"),
    (r"\\leq", "less than or equal to"),
    (r"\\geq", "greater than or equal to"),
    (r"\\neq", "not equal to"),
    (r"=", " equals "),
    (r"\\\{|\\\}|\{|\}", ""),
    (r"\\", ""),
    (r"\s+", " "),
)
NORMAL_STEPS = ((r"\s+", " "), (r"\\left|\\right", ""), (r"\{([^{}])\}", "<1>"), (r"\\,|\\;|\\:|\\!", ""))
INVALID_LATEX = r"\\[a-zA-Z]*[^a-zA-Z\s\{\}\[\]\(\)\^_\\]"
DELIMITED_FORMULAS = (
    (r"(?s)\$\$(.+?)\$\$", 1),
    (r"\$([^$]+?)\$", 1),
    (r"(?s)\\begin\{(equation|align|gather|multline)\*?\}(.+?)\\end\{\1\*?\}", 2),
    (r"(?s)\\\[(.+?)\\\]", 1),
    (r"\\\((.+?)\\\)", 1),
)
BARE_FORMULAS = (
    r"[A-Za-z]+\s*=\s*[^,\.\n]{3,}(?:[\+\-\*/\^]|\\frac|\\sqrt|\\int)",
    r"(?:[A-Z][a-z]?\d*)++\s*(?:->|→|\\rightarrow)\s*(?:[A-Z][a-z]?\d*)++",
)

# Fusion and answers

FUSION_WEIGHTS = {"text": 0.4, "formula": 0.3, "diagram": 0.2, "keyword": 0.1}
OTHER_SOURCE_WEIGHT = 0.1
TYPE_FACTORS = {"formula": {"formula": 2.0, "text": 0.7}, "diagram": {"diagram": 2.0, "text": 0.7}, "keyword": {"keyword": 1.5, "text": 0.8}}
INTENT_FACTORS = {"formula_lookup": {"formula": 1.5}, "visualization": {"diagram": 1.5}, "definition": {"text": 1.3}, "explanation": {"text": 1.3}}
SOURCE_ORDER = ("text", "formula", "diagram", "keyword", "domain")
RRF_K = 60
#: What an answer to a query of each intent should do, in our own words; callers may give others.
INTENT_INSTRUCTIONS = {
    "definition": "Say in one or two sentences what it is, with its symbols if it has any.",
    "explanation": "Go through it in small steps and give a picture for each hard one.",
    "derivation": "Begin with what is given and name the rule used at every line.",
    "example": "Work one case through with numbers.",
    "formula_lookup": "Write the formula in LaTeX and list its symbols with their units.",
    "proof": "State what is assumed, then prove the claim line by line.",
    "comparison": "Put what they share first, then where they differ.",
    "application": "Tell where it is used and how, with a case from practice.",
    "visualization": "Describe what a picture of it would show and what to look at.",
    "calculation": "Write down every intermediate result.",
    "general": "Answer from the given context, and say so where it has no answer.",
}
