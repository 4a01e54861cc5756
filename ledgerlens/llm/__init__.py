"""Training-data operators: sharding, mixing, fingerprints, token files, HTML
extraction, chat repair, licence lookup, toxicity, near-duplicates and
benchmark decontamination.  Nothing else in the library imports this package;
``llm.queries`` registers its queries."""
