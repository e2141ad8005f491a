"""Reading documents and publishing index generations."""
