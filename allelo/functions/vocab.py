"""Vocabularies that must equal the original tool's for identical results."""

# Population -> super-population groupings.
# "phase3" is the 1000 Genomes phase 3 population code list; "survey" groups
# country names of a personal-genome survey; "phase1" is the older code list
# used by the legacy pedigree matcher.
SUPER_POPULATION = {
    "phase3": [
        ("MEX", []),
        ("EUR", ["GBR", "FIN", "IBS", "CEU", "TSI"]),
        ("EAS", ["CHS", "CHB", "CDX", "JPT", "KHV"]),
        ("AMR", ["CLM", "MXL", "PEL", "PUR"]),
        ("SAS", ["BEB", "GIH", "STU", "ITU", "PJL"]),
        ("AFR", ["ACB", "ASW", "GWD", "ESN", "LWK", "MSL", "YRI"]),
    ],
    "survey": [
        ("EUR", ["Sweden", "Finland", "Ireland", "France", "Germany", "Greece",
                 "United Kingdom", "Spain", "Poland", "Belgium"]),
        ("SAS", ["India", "Bangladesh"]),
        ("AMR", ["United States Minor Outlying Islands", "Canada"]),
        ("EUE", ["Bulgeria", "Ukraine", "Estonia", "Slovenia", "Russian Federation"]),
        ("MXL", ["Puerto Rico", "Mexico"]),
        ("AFR", ["South Africa"]),
        ("ASN", ["China", "Taiwan, Province of China"]),
    ],
    "phase1": [
        ("EAS", ["JPT", "CHB", "CHS"]),
        ("SAS", []),
        ("EUR", ["CEU", "TSI", "FIN", "GBR", "IBS"]),
        ("AFR", ["YRI", "LWK", "ASW"]),
        ("AMR", ["MXL", "PUR", "CLM"]),
    ],
}

# Integer label codes used by the classifiers (unknown -> -1).
LABEL_CODES = {
    "super": [("EUR", 0), ("AFR", 1), ("AMR", 2), ("EAS", 3)],
    "population": [("GBR", 0), ("ASW", 1), ("CHB", 2)],
}
