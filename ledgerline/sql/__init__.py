"""The dialect's front end: text to statements, with byte spans."""
