"""Training-data operators: packing, dedup, media, language, HTML, secrets, licences, search and mixing."""
