"""Reports: each takes deals and a filter and returns one lazy DataFrame."""
