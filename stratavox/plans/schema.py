"""Schemas of the tables; unsigned types of sources are widened."""

BLOCK = "cz int, cy int, cx int, z0 long, y0 long, x0 long, nz int, ny int, nx int, dtype string, data binary"
VOXEL = "cz int, cy int, cx int, z long, y long, x long, v long"
CELLS_RAW = "label long, z long, y long, x long, count long, volume long, sum_intensity double"
ONTOLOGY = "id long, atlas_id long, ontology_id long, acronym string, name string, color_hex_triplet string, graph_order long, st_level long, hemisphere_id long, parent_structure_id long"
CHUNK = ("cz", "cy", "cx")
COORDS = ("z", "y", "x")
MEASURES = ("count", "volume", "sum_intensity", "iov")
ANNOTATIONS = ("name", "acronym", "color_hex_triplet", "parent_structure_id", "parent_acronym")
#: Regions outside the ontology (fixed values).
INVALID, UNIVERSE = (-1, "invalid"), (0, "universe")
NO_LABEL = "no_label"
