"""Writers. Every job hands over one (path, content) table; these put it into files."""
