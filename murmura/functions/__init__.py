"""Column functions: text, URLs, times, language, content type, pseudonyms."""
