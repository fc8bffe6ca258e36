"""Training-data operators: near-duplicates, packing, language, URL rules,
quality, mixing, personal data and licences. Nothing else imports this package."""
