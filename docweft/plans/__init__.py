"""Query understanding, search, fusion, context and reports, composed of operators."""
